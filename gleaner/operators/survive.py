"""Which member of a group stays, and what is planned for the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_survivors(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Numbers the members of each group in a total order; 1 survives."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def plan_copies(df: DataFrame, group: list[str], order: list[Column], variants: str, same: str | None = None) -> DataFrame:
    """mark: keep, remove, or "" where variants differ in the group (review) or a row is the keeper's own file.

    ``variants`` is comparable; ``same`` names a column equal for names of one file.
    """
    w = Window.partitionBy(*group)
    df = rank_survivors(df, group, order)
    df = df.withColumn("review", F.min(variants).over(w) != F.max(variants).over(w))
    kept = F.when(F.col("rank") == 1, "keep")
    if same:
        keeper = F.max(F.when(F.col("rank") == 1, F.col(same))).over(w)
        kept = kept.when(F.col(same) == keeper, "")
    return df.withColumn("mark", F.when(F.col("review"), "").otherwise(kept.otherwise("remove")))


def plan_strays(df: DataFrame, group: list[str], placed: str, lossless: str) -> DataFrame:
    """plan for copies outside a collection: keep, delete or held; null where the group needs none.

    A group has a plan if it has a placed and a loose member. A loose lossless member
    is held where no placed member is lossless. Members placed nowhere (null) are kept out.
    """
    w = Window.partitionBy(*group)
    any_placed = F.bool_or(F.coalesce(F.col(placed), F.lit(False))).over(w)
    any_loose = F.bool_or(F.coalesce(~F.col(placed), F.lit(False))).over(w)
    good = F.bool_or(F.col(placed) & F.col(lossless)).over(w)
    df = df.withColumn("__a", any_placed).withColumn("__b", any_loose).withColumn("__g", F.coalesce(good, F.lit(False)))
    loose = F.when(F.col(lossless) & ~F.col("__g"), "held").otherwise("delete")
    plan = F.when(F.col("__a") & F.col("__b"), F.when(F.col(placed), "keep").when(~F.col(placed), loose))
    return df.withColumn("plan", plan).drop("__a", "__b", "__g")


def in_collection(path: Column, root: str, depth: int = 3) -> Column:
    """True from ``depth`` parts below root on, false above, null outside."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.size(F.split(F.substring(path, len(base) + 1, 1 << 20), "/")) >= depth)


def picked_deletions(df: DataFrame, picks: DataFrame, group: list[str], member: str) -> DataFrame:
    """Rows picked for deletion, save in groups where every member is picked."""
    marked = df.join(picks.select(member).distinct().withColumn("__picked", F.lit(True)), member, "left")
    all_picked = F.min(F.coalesce(F.col("__picked"), F.lit(False))).over(Window.partitionBy(*group))
    return marked.withColumn("__all", all_picked).where("__picked and not __all").drop("__picked", "__all")


def summary(df: DataFrame, group: list[str], size: str) -> DataFrame:
    """Groups, rows and units freed by a plan with columns mark and review."""
    return df.agg(
        F.count_distinct(*group).alias("groups"), F.count_if(F.col("mark") == "remove").alias("removals"),
        F.coalesce(F.sum(F.when(F.col("mark") == "remove", F.col(size))), F.lit(0)).alias("freed"), F.count_distinct(F.when(F.col("review"), F.struct(*group))).alias("reviews"),
    )
