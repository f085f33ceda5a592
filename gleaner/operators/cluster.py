"""Grouping by key and one-dimensional gap clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.scan import Scan


def gap_clusters(df: DataFrame, keys: list[str], value: str, tolerance: float, ties: list[str], cluster: str = "cluster", size: str = "cluster_size", least: int = 2) -> DataFrame:
    """Rows whose value is within ``tolerance`` of the row before it (in key, by value) form a cluster.

    A cluster may span more than the tolerance. Clusters of fewer than ``least`` rows go.
    Rows with a null key or value are dropped. A key with any number of rows is cut into ranges (see ``scan``).
    """
    s = Scan(df.dropna(subset=[*keys, value]), keys, [value, *ties]).add(__before=("lag", F.col(value)))
    s = s.compute(__new=F.coalesce((F.col(value) - F.col("__before") > tolerance).cast("long"), F.lit(0)))
    rows = s.add(**{cluster: ("sum", F.col("__new"))}).df.drop("__before", "__new").checkpoint()
    sizes = rows.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias(size)).where(F.col(size) >= least)
    return rows.join(sizes, [*keys, cluster]).select(*df.columns, cluster, size)


def duplicate_keys(df: DataFrame, key: str, members: str, least: int = 2) -> DataFrame:
    """Keys that at least ``least`` rows share: (key, n, first member). Empty keys don't count."""
    return df.where(F.col(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(members).alias("first_member")).where(F.col("n") >= least)


def spelling_mode(df: DataFrame, key: str, spelling: str, position: str) -> DataFrame:
    """The most frequent spelling of each key, the first seen on a tie, with the key's rows."""
    counted = df.groupBy(key, spelling).agg(F.count(F.lit(1)).alias("uses"), F.min(position).alias("first_seen"))
    w = Window.partitionBy(key).orderBy(F.desc("uses"), "first_seen", spelling)
    total = F.sum("uses").over(Window.partitionBy(key))
    return counted.withColumn("total", total).withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def explode_counts(df: DataFrame, items: str, member: str, name: str = "name") -> DataFrame:
    """Members of each item of an array column, counted once each: (name, n, first_member)."""
    each = df.select(F.col(member), F.explode(F.array_distinct(items)).alias(name))
    return each.groupBy(name).agg(F.count_distinct(member).alias("n"), F.min(member).alias("first_member"))


def first_unique(df: DataFrame, key: str, value: str) -> DataFrame:
    """key -> value where only one row has the key; ambiguous keys go."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")
