"""Connected components of an edge table: each task joins what its edges join, then large and small stars alternate.

A task's edges become stars around the smallest node of each component that they form, with memory for ``EDGES`` of them
at a time. A table of so few is done then; every round that it would have taken is half a dozen shuffles, whose plans,
threads and results the driver keeps for a while. A larger one goes on with stars over the cluster. Each round replaces every edge by one to the smallest neighbour, first for the
larger ends, then for the smaller ones; the table ends as stars around the
smallest node of each component. A round is partial aggregates and equi-joins, so
a hub's edges may be split (adaptive skew joins); nothing goes to the driver but
two counters. Each round is checkpointed, so lost executors cost one round, and the
shuffle files of the rounds before are given up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import release

#: Edges that one task joins at once: 4 MB of them.
EDGES = 1 << 18


def fitted(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """A checkpointed table in no more partitions than its rows need: a small one makes few tasks and few shuffle files."""
    return df.coalesce(max(1, -(-rows // each)))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # an edge makes one row at most; the small star that follows leaves out repeated ones
    return both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(low, "a")
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some edges that isn't the smallest of its component, beside that one."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        # roots go below smaller roots, then every node to its root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    others = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[others], nodes[root[others]]


def _joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a task -> stars with the same components; of up to ``most`` edges, those of the components."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a, b = np.append(a, np.asarray(batch.column(0))), np.append(b, np.asarray(batch.column(1)))
        if len(a) > most:
            a, b = star(a, b)
            if len(a) > most // 2:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a = b = np.zeros(0, np.int64)
    a, b = star(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame, rounds: int = 60, most: int = EDGES) -> DataFrame:
    """edges (a, b) of one sortable type -> (node, root) for all nodes but the roots.

    Edges may repeat, in both directions; an edge with a null end, or of a node with itself, links nothing; an empty table gives an empty one.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    many, seen = now.count(), None
    if dict(now.dtypes)["a"] == "bigint":
        now = fitted(now, many, most).mapInArrow(lambda b: _joined(b, most), "a long, b long").checkpoint()
        release(now)
        if many <= most:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        many = now.count()
    now = fitted(now, many)
    for _ in range(rounds):
        now = _small(_large(now)).checkpoint()
        release(now)
        # the same edges hash to the same sum
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, seen = fitted(now, mark[0]), mark
    raise RuntimeError("components did not settle")
