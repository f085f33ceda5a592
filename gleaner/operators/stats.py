"""Coverage and health reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(df: DataFrame, by: list[str], have: Column, capable: Column | None = None) -> DataFrame:
    """total, have, missing and incapable rows by group."""
    able = F.lit(True) if capable is None else capable
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(have).alias("have"), F.count_if(able & ~have).alias("missing"), F.count_if(~able).alias("incapable"))


def scoped(df: DataFrame, path: str, folders: list[str]) -> DataFrame:
    """Rows of each folder; folders that overlap count a row more than once, on purpose."""
    out = None
    for f in folders:
        part = df.where(F.col(path).startswith(f.rstrip("/") + "/")).withColumn("folder", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.limit(0).withColumn("folder", F.lit(None).cast("string"))


def failure_reasons(df: DataFrame, reason: str, many: int = 6, few: int = 2) -> DataFrame:
    """(reason, n, collapsed): collapsed where many failures have few reasons."""
    by = df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))  # one row
    return by.crossJoin(F.broadcast(total)).select(reason, "n", ((F.col("all") > many) & (F.col("kinds") <= few)).alias("collapsed"))


def head_with_total(df: DataFrame, order: list[Column], shown: int = 12) -> DataFrame:
    """The first rows of a report and how many there are in all."""
    return df.orderBy(*order).limit(shown).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total_rows"))))
