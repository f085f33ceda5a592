"""Prefix scans in the order of a key's rows, where one key may be larger than any task.

A window function gathers a key's rows in one task. Here rows are cut into ranges of (key,
order): a large key lies in several consecutive ranges, a small one in one. Each range is
scanned by itself; the last row of a range holds what it adds up to; these sums, one for each key and range,
are scanned in turn, and what stands before a range is added to its rows. That is right
for every associative operation, of which there are four here: sum, max, min and last.

A range holds at most one key that began in an earlier one, so no more rows are sent back to
the ranges than there are ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import shared_dir

CHUNK = "__chunk"


def _plus(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


#: name -> (aggregate over earlier rows, how a later part joins an earlier one)
_KINDS = {
    "sum": (F.sum, lambda early, late: _plus(early, late)),
    "max": (F.max, lambda early, late: F.greatest(early, late)),
    "min": (F.min, lambda early, late: F.least(early, late)),
    "last": (lambda x: F.last(x, ignorenulls=True), lambda early, late: F.coalesce(late, early)),
}


class Scan:
    """Rows of ``df`` in ``order`` within ``keys`` (no keys: one sequence of all rows).

    Null keys are a key of their own. ``order`` should leave no ties; tied rows keep one order for
    all that is added, as rows are written to the checkpoint folder once they are cut into ranges.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str | Column], ranges: int | None = None):
        shared_dir(df.sparkSession)
        self.keys, self.order = keys, [F.col(o) if isinstance(o, str) else o for o in order]
        ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows = df.repartitionByRange(ranges, *(F.col(k) for k in keys), *self.order).withColumn(CHUNK, F.spark_partition_id()).checkpoint()

    @property
    def df(self) -> DataFrame:
        return self.rows.drop(CHUNK)

    def compute(self, **columns: Column) -> Scan:
        """Further columns, made row by row."""
        self.rows = self.rows.withColumns(columns)
        return self

    def add(self, **wanted: tuple[str, Column]) -> Scan:
        """name=(kind, value) with kind sum, max, min or last (not null), each up to this row; with ``_before`` up to the row before; or lag."""
        local = Window.partitionBy(*self.keys, CHUNK).orderBy(*self.order)
        upto, before = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(Window.unboundedPreceding, -1)
        made, kinds = {"__scan_end": F.lead(F.lit(True)).over(local).isNull()}, {}
        for name, (kind, value) in wanted.items():
            if kind == "lag":
                kind, value = "last_before", F.struct(value.alias("v"))  # a null is a value here
            kinds[name] = kind.removesuffix("_before")
            aggregate = _KINDS[kinds[name]][0]
            made[name] = aggregate(value).over(before if kind.endswith("_before") else upto)
            made[f"__{name}"] = aggregate(value).over(upto)
        rows = self.rows.withColumns(made)
        ends = rows.where("__scan_end").select(*self.keys, CHUNK, *(f"__{n}" for n in wanted))
        earlier = Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carried = {f"__{n}": _KINDS[k][0](F.col(f"__{n}")).over(earlier) for n, k in kinds.items()}
        carried = ends.withColumns({"__scan_first": F.min(CHUNK).over(Window.partitionBy(*self.keys)), **carried}).where(F.col(CHUNK) > F.col("__scan_first"))
        # one key of each range at most began before it
        carried = F.broadcast(carried.select(*(F.col(k).alias(f"__scan_key{i}") for i, k in enumerate(self.keys)), F.col(CHUNK).alias("__scan_at"), *(F.col(f"__{n}").alias(f"__scan_early_{n}") for n in wanted)))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__scan_key{i}")) for i, k in enumerate(self.keys)), F.col(CHUNK) == F.col("__scan_at"))
        out = rows.drop("__scan_end", *(f"__{n}" for n in wanted)).join(carried, same, "left")
        for name, (kind, _) in wanted.items():
            whole = _KINDS[kinds[name]][1](F.col(f"__scan_early_{name}"), F.col(name))
            out = out.withColumn(name, whole["v"] if kind == "lag" else whole)
        self.rows = out.select(*(c for c in self.rows.columns if c not in wanted), *wanted)
        return self


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "number") -> DataFrame:
    """1, 2, ... within each key."""
    return Scan(df, keys, order).add(**{name: ("sum", F.lit(1).cast("long"))}).df


def first_n(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    """The first n rows in order (a limit below 0 counts as 0), without bringing them into one task."""
    return numbered(df, [], order, "__n").where(F.col("__n") <= max(n, 0)).drop("__n")


def stop_after(df: DataFrame, keys: list[str], order: list[str | Column], failed: Column, most: int = 3) -> DataFrame:
    """tried: whether a row is reached when work on a key ends after ``most`` failures in a row; streak: failures in a row up to this one.

    A null of ``failed`` counts as success.
    """
    bad = F.coalesce(failed, F.lit(False))
    s = Scan(df, keys, order).compute(__bad=bad).add(__n=("sum", F.lit(1).cast("long")))
    s = s.add(__ok=("last", F.when(~F.col("__bad"), F.col("__n")))).compute(streak=F.col("__n") - F.coalesce("__ok", F.lit(0)))
    s = s.add(__over=("max_before", F.col("streak") >= most)).compute(tried=~F.coalesce("__over", F.lit(False)))
    return s.df.drop("__bad", "__n", "__ok", "__over")


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A range's rows (chunk, h, g, amount) in order -> (chunk, h, g, kind, low, used, n) of its first and its last key.

    Kind 0, of the first key: what an open batch from before comes to, for sizes of it above ``low`` (the greatest such row counts): n
    batches begin here and the last has the size ``used``; with n = 0 ``used`` is added. Kind 1, of the last key: the same if it begins here.
    """
    first, head, last, used, n = [], None, None, 0, 0
    chunk = None
    for batch in batches:
        for chunk, h, g, q in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if (h, g) != last:
                last, used, n = (h, g), q, 1
                head = head or last
            elif used + q > most:
                used, n = q, n + 1
            else:
                used += q
            if last == head:
                first.append(q)
    if head is None:
        return
    out = [(*last, 1, None, used, n)]
    size = np.array(first, np.int64)
    upto = np.cumsum(size)
    following = np.maximum(np.arange(1, len(size) + 1), np.searchsorted(upto, upto - size + most, "right")).tolist()
    # from the last row back: the size of the last batch and how many there are, if one begins at the row
    end, many, whole = [0] * len(first), [1] * len(first), int(upto[-1])
    for i in range(len(first) - 1, -1, -1):
        k = following[i]
        end[i], many[i] = (end[k], many[k] + 1) if k < len(first) else (whole - int(upto[i]) + first[i], 1)
    for i in range(len(first)):
        if i == 0 or first[i]:
            out.append((*head, 0, most - int(upto[i]), end[i], many[i]))
        if upto[i] > most:
            break
    else:
        out.append((*head, 0, -1, whole, 0))
    h, g, kind, low, used, n = zip(*out, strict=True)
    columns = [pa.array([chunk] * len(out), pa.int32()), pa.array(h, pa.int64()), pa.array(g, pa.int32()), pa.array(kind, pa.int32()), *(pa.array(x, pa.int64()) for x in (low, used, n))]
    yield pa.RecordBatch.from_arrays(columns, ["chunk", "h", "g", "kind", "low", "used", "n"])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_parts`` by key and range, low from the greatest down -> (chunk, h, g, used, n): the batch that is open before a range."""
    key, state, at, done = None, None, None, False
    for batch in batches:
        out = []
        for chunk, h, g, kind, low, used, n in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            if (h, g) != key:
                key, state, at = (h, g), None, None
            if chunk != at:
                at, done = chunk, False
                if state is not None:
                    out.append((chunk, h, g, *state))
            if done or (kind == 1) != (state is None):
                continue
            if state is None:
                state, done = (used, n), True
            elif low < state[0]:
                state, done = (used if n else state[0] + used, state[1] + n), True
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["chunk", "h", "g", "used", "n"])


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A range's rows (..., h, g, amount, used, n) in order -> the other columns and batch."""
    key, used, n = None, 0, 0
    for batch in batches:
        wide, out = batch.num_columns - 5, []
        for h, g, q, before, had in zip(*(batch.column(wide + c).to_pylist() for c in range(5)), strict=True):
            if (h, g) != key:
                key = (h, g)
                used, n = (0, 1) if before is None else (before, had)
                if before is None:
                    used = q
                    out.append(0)
                    continue
            if used + q > most:
                used, n = q, n + 1
            else:
                used += q
            out.append(n - 1)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(wide)), pa.array(out, pa.int64())], [*batch.schema.names[:wide], "batch"])


def size_batches(df: DataFrame, keys: list[str], order: list[str | Column], size: str, most: int) -> DataFrame:
    """batch: 0, 1, ... within each key; a batch takes rows while their sizes add up to at most ``most``, a larger row is a batch of its own.

    Sizes are not negative; null sizes count as 0. Rows are read in order, range by range. All that a range needs to know of those before is
    the size of the batch that is open, and what that comes to at the range's end is a step function of it with
    ``most`` + 2 steps at most. These functions, of one key in each range, are followed first; then all ranges go side by side.
    """
    amount = F.coalesce(F.col(size), F.lit(0)).cast("long")
    s = Scan(df, keys, order)
    # two hashes tell neighbouring keys apart
    key = [F.xxhash64(*keys).alias("__h"), F.hash(*keys).alias("__g")] if keys else [F.lit(0).cast("long").alias("__h"), F.lit(0).alias("__g")]
    by = [F.col(CHUNK), *(F.col(k) for k in keys), *s.order]
    rows = s.rows.sortWithinPartitions(*by).select(F.col(CHUNK).cast("int").alias("chunk"), *key, amount.alias("amount"))
    parts = rows.mapInArrow(lambda b: _parts(b, most), "chunk int, h long, g int, kind int, low long, used long, n long")
    parts = parts.repartition("h", "g").sortWithinPartitions("h", "g", "chunk", "kind", F.desc("low"))
    carried = parts.mapInArrow(_carried, "chunk int, h long, g int, used long, n long").checkpoint()
    known = F.broadcast(carried.select(F.col("chunk").alias(CHUNK), F.col("h").alias("__h"), F.col("g").alias("__g"), F.col("used").alias("__used"), F.col("n").alias("__n")))
    every = s.rows.withColumns({"__h": key[0], "__g": key[1], "__amount": amount}).join(known, [CHUNK, "__h", "__g"], "left").sortWithinPartitions(*by)
    kind = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])
    return every.select(*df.columns, "__h", "__g", "__amount", "__used", "__n").mapInArrow(lambda b: _batches(b, most), kind)
