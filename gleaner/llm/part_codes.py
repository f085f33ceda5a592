"""Vector codes: integer product quantization, its nearest entries found through segment-mean lower bounds.

Each component x counts as ``floor(1024 * x)``, so every distance and every mean is exact
and no result depends on the order of rows. A vector is cut into consecutive parts; each
part position has a codebook of up to 256 entries, refined by rounds of k-means.

The nearest entry of a part is found coarse to fine. A part is cut into blocks (1, then 4,
then 16, ...); with the block means and the norm of what the means leave over,

    d(x, y) >= sum over blocks of width * (mean x - mean y)^2  +  (|rest x| - |rest y|)^2

by Cauchy-Schwarz. Its right side is itself a squared distance, between short summaries
(root of width * mean of each block, norm of the rest) that have the norms of x and y, so
all bounds of a block of rows are one matrix product. An entry whose bound is above a distance that some other entry is known
to have can't be nearest and is left out; only rows that still have several entries go on to finer
blocks. Bounds are doubles and are lowered by more than their rounding error. What
survives gets its exact 64-bit integer distance, and the lowest index wins ties.

On Spark: a round is one pass over the vectors. A task keeps sums and counts of its own
rows, (parts x entries x width) numbers, whatever its rows are; these are added in a shuffle
and the codebooks, which have a fixed size, go to the tasks of the next pass.

Defined cases. Null vectors, and vectors with a null, NaN or infinite component, are
dropped. Vectors have the commonest length among the rest (the greater of two as common); those of
another length have no place in the codebooks and are dropped too. A length that the parts don't divide is cut at
``i * length // parts``. With fewer vectors than entries the codebooks are shorter. Rows
may repeat ids; ids that are null come last among the smallest. Null labels are one group. An empty table gives
an empty result. Other columns are ignored. Distances above 2^62 raise OverflowError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import shared_dir, ship

SCALE = 1024
#: Rows of a block of work, and (row, entry) pairs that are compared at once.
ROWS, PAIRS = 1024, 1 << 16


@dataclass(frozen=True)
class Codebooks:
    """entries: for each part an int64 array (entries, width); length: of a whole vector."""

    entries: tuple[np.ndarray, ...]
    length: int

    @property
    def bounds(self) -> list[tuple[int, int]]:
        n = len(self.entries)
        return [(i * self.length // n, (i + 1) * self.length // n) for i in range(n)]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.entries for x in book.ravel().tolist()).encode()).hexdigest()


def kept(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is whole and finite."""
    return df.where(F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def scaled(column: pa.Array, length: int) -> np.ndarray:
    """(rows, length) of floor(1024 * x); the rows hold whole vectors of that length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(len(column), length)
    if x.size and np.abs(x).max() ** 2 * 4 * length >= 2.0**62:
        raise OverflowError("distances of these vectors don't fit 64 bits")
    return x.astype(np.int64)


class Levels:
    """Summaries of the rows of an integer array, for 1, 4, 16, ... blocks, at last of one component; each has its row's norm."""

    def __init__(self, x: np.ndarray):
        width = x.shape[1]
        self.norm = (x * x).sum(1).astype(np.float64)
        self.summary: list[np.ndarray] = []
        blocks = 1
        while True:
            cuts = [i * width // blocks for i in range(blocks + 1)]
            sums = np.stack([x[:, a:b].sum(1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], 1)
            mean = sums / np.sqrt(np.maximum(np.diff(cuts), 1))  # the mean times the root of the width: its square is what the block's mean adds
            rest = np.sqrt(np.maximum(self.norm - (mean * mean).sum(1), 0))
            self.summary.append(np.column_stack((mean, rest)))
            if blocks >= width:
                break
            blocks = min(4 * blocks, width)


def nearest(x: np.ndarray, book: np.ndarray, levels: Levels | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the index and squared distance of its nearest entry, and how many exact distances that took."""
    levels = levels or Levels(book)
    index, far, exact = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    for lo in range(0, len(x), ROWS):
        part = x[lo : lo + ROWS]
        index[lo : lo + ROWS], far[lo : lo + ROWS], n = _nearest(part, book, levels)
        exact += n
    return index, far, exact


def _distance(x: np.ndarray, book: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for lo in range(0, len(i), PAIRS):
        d = x[i[lo : lo + PAIRS]] - book[j[lo : lo + PAIRS]]
        out[lo : lo + PAIRS] = (d * d).sum(1)
    return out


def _nearest(x: np.ndarray, book: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray, int]:
    own = Levels(x)
    rows = np.arange(len(x))
    best = np.full(len(x), np.iinfo(np.int64).max)
    alive = np.ones((len(x), len(book)), bool)
    open_, exact = rows, 0  # rows with several entries
    for mine, its in zip(own.summary, levels.summary, strict=True):
        norms = own.norm[open_, None] + levels.norm[None, :]
        # twice the product and both norms are rounded to some 1e-15 of the norms: 1e-9 of them is taken off
        bound = norms * (1 - 1e-9) - 1e-6 - 2 * (mine[open_] @ its.T)
        bound[~alive[open_]] = np.inf
        best[open_] = np.minimum(best[open_], _distance(x, book, open_, bound.argmin(1)))
        exact += len(open_)
        alive[open_] = bound <= best[open_, None]
        open_ = open_[alive[open_].sum(1) > 1]
        if not len(open_):
            break
    i, j = np.nonzero(alive)
    d = _distance(x, book, i, j)
    exact += len(d)
    least = np.minimum.reduceat(d, np.searchsorted(i, rows)) if len(d) else d
    tied = np.flatnonzero(d == least[i])  # in order of row, then of index
    return j[tied[np.searchsorted(i[tied], rows)]], least, exact


def _parts(column: pa.Array, books: Codebooks) -> Iterator[tuple[int, np.ndarray]]:
    x = scaled(column, books.length)
    for k, (a, b) in enumerate(books.bounds):
        yield k, x[:, a:b]


def _sums(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """What one task adds to each entry: (part, entry, pos, total); pos -1 counts rows."""
    levels = [Levels(b) for b in books.entries]
    total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books.entries]
    for batch in batches:
        for k, x in _parts(batch.column(0), books):
            index = nearest(x, books.entries[k], levels[k])[0]
            order = np.argsort(index, kind="stable")
            used, first = np.unique(index[order], return_index=True)
            if len(used):
                total[k][used, 1:] += np.add.reduceat(x[order], first, axis=0)
                total[k][used, 0] += np.diff(np.append(first, len(order)))
    for k, t in enumerate(total):
        entry, pos = np.nonzero(t[:, :1] + np.zeros_like(t))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), k, np.int32)), pa.array(entry.astype(np.int32)), pa.array((pos - 1).astype(np.int32)), pa.array(t[entry, pos])], ["part", "entry", "pos", "total"])


def _codes(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    levels = [Levels(b) for b in books.entries]
    for batch in batches:
        code, error = np.zeros((batch.num_rows, len(levels)), np.uint8), np.zeros(batch.num_rows, np.int64)
        for k, x in _parts(batch.column(0), books):
            index, far, _ = nearest(x, books.entries[k], levels[k])
            code[:, k] = index
            error += far
        text = code.tobytes().hex()
        wide = 2 * len(levels)
        codes = pa.array([text[i : i + wide] for i in range(0, len(text), wide)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], codes, pa.array(error)], [*batch.schema.names[1:], "code", "error"])


def _length(whole: DataFrame) -> int | None:
    """The commonest length of the vectors (column vec)."""
    found = whole.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return found[0]["length"] if found else None


def fit(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks that start at the vectors of the smallest ids (equal ids: in order of their components) and go through ``rounds`` of k-means."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    ship(df.sparkSession)
    whole = kept(df, vec_col).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    length = _length(whole)
    if length is None:
        return Codebooks(tuple(np.zeros((0, 0), np.int64) for _ in range(parts)), 0)
    whole = whole.where(F.size("vec") == length)
    # as many rows as a codebook has entries
    start = scaled(whole.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).toArrow().column("vec"), length)
    books = Codebooks(tuple(start[:, i * length // parts : (i + 1) * length // parts].copy() for i in range(parts)), length)
    vectors = whole.select("vec")
    for _ in range(rounds):
        now = books
        added = vectors.mapInArrow(lambda b: _sums(b, now), "part int, entry int, pos int, total long")  # noqa: B023  the pass runs before the next begins
        got = added.groupBy("part", "entry", "pos").agg(F.sum("total").alias("total")).toArrow()  # a row for each number of the codebooks
        fresh = [b.copy() for b in books.entries]
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books.entries]
        part, entry, pos, total = (np.asarray(got[c]) for c in ("part", "entry", "pos", "total"))
        for k, s in enumerate(sums):
            own = part == k
            s[entry[own], pos[own] + 1] = total[own]
            used = s[:, 0] > 0
            fresh[k][used] = s[used, 1:] // s[used, :1]  # floors, also below 0
        books = Codebooks(tuple(fresh), length)
    return books


def encode(df: DataFrame, books: Codebooks, vec_col: str = "embedding", keep: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """The columns ``keep``, with code (two hex digits a part) and error (squared distance to what the code stands for)."""
    ship(df.sparkSession)
    whole = kept(df, vec_col).where(F.size(vec_col) == books.length)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return whole.select(F.col(vec_col), *keep).mapInArrow(lambda b: _codes(b, books), f"{kinds}, code string, error long")


def decode(codes: list[str], books: Codebooks) -> np.ndarray:
    """The vectors that codes stand for: entries over 1024."""
    index = np.frombuffer(bytes.fromhex("".join(codes)), np.uint8).reshape(len(codes), -1)
    return np.concatenate([b[index[:, k]] for k, b in enumerate(books.entries)], 1) / SCALE


def digests(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (error of all rows with an equal label) and codebooks_sha256 of each row that is kept."""
    shared_dir(df.sparkSession)
    books = fit(df, id_col, vec_col)
    rows = encode(df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("embedding")), books).checkpoint()
    # a label may hold a third of all rows: rows are joined with one row a label, not gathered by label
    total = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(total, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
