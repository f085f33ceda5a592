"""gleaner: a Spark-native engine that cleans and reconciles large collections."""
