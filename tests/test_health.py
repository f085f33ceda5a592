from pyspark.sql import functions as F

from gleaner.operators import health

c = F.col


def test_one_scan_gives_rows_failures_and_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, "5", 2.0), (2, "x", None), (3, None, -1.0), (4, "7", 0.5)], "i int, n string, v double")
    rows = health.checked(df, {"no number": F.try_to_number("n", F.lit("9")).isNull(), "negative": c("v") < 0})
    assert {r.i: r.errors for r in rows.collect()} == {1: [], 2: ["no number"], 3: ["no number", "negative"], 4: []}
    assert {(r.reason, r.n, r.first_member) for r in health.reasons(rows, "i").collect()} == {("ok", 2, 1), ("no number", 2, 2), ("negative", 1, 3)}
    path = str(tmp_path / "out")
    assert health.write(rows, path, total=F.sum("v")) == {"rows": 4, "failed": 2, "total": 1.5}
    assert sorted(r.i for r in health.read(spark, path).collect()) == [1, 4]
    assert sorted((r.i, *r.errors) for r in health.read(spark, path, failed=True).collect()) == [(2, "no number"), (3, "no number", "negative")]


def test_a_step_that_fails_does_not_stop_the_others(spark):
    got = health.findings({
        "rows": lambda: spark.range(5).agg(F.count(F.lit(1)).alias("n")),
        "missing": lambda: spark.read.parquet("/nowhere/at/all"),
        "raises": lambda: spark.range(1).select(F.raise_error(F.lit("broken")).alias("x")),
        "empty": lambda: spark.range(0),
    })
    assert [(s, v, e is None) for s, v, e in got] == [("rows", {"n": 5}, True), ("missing", None, False), ("raises", None, False), ("empty", {}, True)]
