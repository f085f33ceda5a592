"""Rows with their failures beside them, and a run's summary, all from one scan.

A row that breaks a rule stays a row: it carries the names of what it breaks. One write sends good rows and
the others to folders of their own, and counts both on the way (``observe``), so no second scan is made for a report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checked(df: DataFrame, rules: dict[str, Column], name: str = "errors") -> DataFrame:
    """errors: names of the rules whose column is true, in their order. A rule that gives null isn't broken; use ``try_`` functions in rules that could fail."""
    broken = F.array(*(F.when(rule, F.lit(rule_name)) for rule_name, rule in rules.items()))
    return df.withColumn(name, F.filter(broken, lambda x: x.isNotNull()))


def reasons(rows: DataFrame, member: str, name: str = "errors") -> DataFrame:
    """(reason, n, first_member): rows of each reason, good ones under ``ok``; a row with two reasons counts under both."""
    each = rows.select(member, F.explode(F.when(F.size(name) == 0, F.array(F.lit("ok"))).otherwise(F.col(name))).alias("reason"))
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("first_member"))


def write(rows: DataFrame, path: str, name: str = "errors", **metrics: Column) -> dict:
    """Writes rows with errors to ``path/failed=true`` and the others to ``path/failed=false``; gives rows, failed, and further metrics of the same pass."""
    seen = Observation()
    failed = F.size(name) > 0
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(failed).alias("failed"), *(m.alias(k) for k, m in metrics.items())]
    rows.withColumn("failed", failed).observe(seen, *counts).write.partitionBy("failed").parquet(path)
    return seen.get


def read(spark: SparkSession, path: str, failed: bool = False) -> DataFrame:
    """Good rows, or the others; only that folder is read."""
    return spark.read.parquet(path).where(F.col("failed") == failed).drop("failed")


def findings(steps: dict[str, Callable[[], DataFrame]]) -> list[tuple[str, dict | None, str | None]]:
    """(step, its one row, its error) for each step, in order; a step that fails is told and doesn't stop the others.

    A step gives a DataFrame of one row, such as the counts of a report.
    """
    out = []
    for step, make in steps.items():
        try:
            row = make().first()
            out.append((step, row.asDict() if row else {}, None))
        except (PySparkException, ValueError, OSError) as e:
            out.append((step, None, (str(e).strip() or type(e).__name__).splitlines()[0]))
    return out
