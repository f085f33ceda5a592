"""Hierarchical weighted hash tree: shards of documents, without Python on the data path.

A tree has regions, regions have racks, racks have shards; every shard has a
weight and every inner node weighs what its shards weigh together. A key
descends level by level. On each level every child draws ``-ln(u) / weight``,
with u a hash of (key, level, child) in (0, 1), and the smallest draw wins, so a
child wins in proportion to its weight. A child's draw depends on nothing but
the key, its own name and its own weight: where weights stay as they are,
draws stay, and only keys that the changed subtree wins or loses can move.

Law kept: ``key``. The key and the tree decide and nothing else does. One more
shard joins as a region of its own (``grown``): no old node's weight changes,
so the new region wins keys from all others and no key moves between old shards.
Sizes and counts are even only as far as hashing makes them.

Defined cases: a null text has 0 bytes (size 1) and crc32 0; a null key is a key
like any other ("" after a null mark); equal rows get slots of their own; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("region", "rack", "shard")
RUN = 1 << 16


@dataclass(frozen=True)
class Shard:
    """A leaf: its path in the tree and its weight (0: takes nothing)."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, racks_of: int = 2, regions_of: int = 4) -> tuple[Shard, ...]:
    """Shards 0.. in racks of ``racks_of`` and regions of ``regions_of`` shards."""
    return tuple(Shard(i // regions_of, i // racks_of, i) for i in range(shards))


def grown(tree: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """The tree with one more shard, in a new rack of a new region."""
    return (*tree, Shard(1 + max(s.region for s in tree), 1 + max(s.rack for s in tree), 1 + max(s.shard for s in tree), weight))


def _draw(key: Column, level: str, child: int, weight: float) -> Column:
    """-ln(u) / weight; u from the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{level}:{child}:"), key))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.ln(u) / F.lit(float(weight))


def _winner(key: Column, level: str, children: dict[int, float]) -> Column:
    live = {c: w for c, w in sorted(children.items()) if w > 0}
    if not live:
        raise ValueError(f"no child with a weight on level {level}")
    if len(live) == 1:
        return F.lit(next(iter(live)))
    return F.array_min(F.array(*(F.struct(_draw(key, level, c, w).alias("draw"), F.lit(c).alias("child")) for c, w in live.items())))["child"]


def _weights(tree: tuple[Shard, ...], level: str, **under: int) -> dict[int, float]:
    out: dict[int, float] = {}
    for s in tree:
        if all(getattr(s, k) == v for k, v in under.items()):
            out[getattr(s, level)] = out.get(getattr(s, level), 0.0) + s.weight
    return out


def descend(df: DataFrame, key: Column, tree: tuple[Shard, ...], prefix: str = "") -> DataFrame:
    """df with columns {prefix}region, {prefix}rack and {prefix}shard: narrow, no shuffle."""
    region, rack, shard = (f"{prefix}{x}" for x in LEVELS)
    df = df.withColumn(region, _winner(key, "region", _weights(tree, "region")))

    def below(level: str, parent: str, column: str) -> Column:
        out = None
        for p, w in _weights(tree, parent).items():
            if w > 0:
                win = _winner(key, level, _weights(tree, level, **{parent: p}))
                out = F.when(F.col(column) == p, win) if out is None else out.when(F.col(column) == p, win)
        return out

    df = df.withColumn(rack, below("rack", "region", region))
    # never null: joins on it add no filter, so plans over one table stay alike and share their exchange
    return df.withColumn(shard, F.coalesce(below("shard", "rack", rack), F.lit(-1)))


def key_of(column: Column) -> Column:
    """The key as text; null differs from every value."""
    return F.coalesce(F.concat(F.lit("k"), column.cast("string")), F.lit("null"))


def place(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree: tuple[Shard, ...] | None = None, buckets: int = 256) -> DataFrame:
    """One row for each row of df: id, size, text_crc32, law, region, rack, shard, slot, grown_shard.

    Slots are gapless from 0 in each shard without ordering a shard in one task.
    Rows that agree in id, size and checksum are counted first, with partial sums
    before the shuffle, which also dissolves hot keys. Each shard is split into
    ``buckets`` by hash; counts of the (shards x buckets) cells become offsets, and
    rows are numbered in their cell. Texts never leave the scan. Copies become rows
    again in runs of ``RUN``, spread over the tasks.
    """
    tree = tree or even_tree(8)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    key = key_of(F.col("doc_id"))
    placed = descend(descend(counted, key, tree), key, grown(tree), "grown_")
    digest = F.md5(F.concat_ws(":", F.lit("bucket"), key, F.col("size").cast("string"), F.col("text_crc32").cast("string")))
    placed = placed.withColumn("bucket", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).withColumn("bucket", F.coalesce("bucket", F.lit(0).cast("long")))
    cells = placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("cell_rows"))
    by_shard = "sum(cell_rows) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding)"
    offsets = cells.select("shard", "bucket", F.coalesce(F.expr(by_shard), F.lit(0)).alias("offset"))
    # at most shards x buckets rows, however many documents there are
    placed = placed.join(F.broadcast(offsets), ["shard", "bucket"])
    order = "partition by shard, bucket order by doc_id, size, text_crc32 rows between unbounded preceding and 1 preceding"
    placed = placed.withColumn("before", F.coalesce(F.expr(f"sum(copies) over ({order})"), F.lit(0)))
    # a row for each copy again: in runs, which are dealt out, so that a hot row is no array and no task of its own
    runs = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))).alias("run"))
    runs = runs.repartition("doc_id", "size", "text_crc32", "run")
    last = F.least(F.col("copies"), (F.col("run") + 1) * RUN) - 1
    return runs.select("*", F.explode(F.sequence(F.col("run") * RUN, last)).alias("copy")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard",
        (F.col("offset") + F.col("before") + F.col("copy")).alias("slot"), F.col("grown_shard"),
    )
