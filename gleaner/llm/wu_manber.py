"""Benchmark decontamination by Wu-Manber search over word sequences.

A benchmark item gives its windows of ``width`` consecutive words as patterns (an
item of fewer words is one pattern). Symbols are words: runs of letters, digits
and all characters above ASCII, A-Z in lower case, as 64-bit hashes. For patterns
of one length m and blocks of B words (B = 2, or 1 for m = 1):

- shift: a table by block hash. A block that ends j words before the end of some
  pattern may be shifted by j at most, a block in no pattern by m - B + 1;
  positions in between cannot end an occurrence and are skipped;
- bucket: where the shift is 0, the block's suffix hash selects the patterns that
  end with it;
- comparison: the candidate's words are compared with the document's, byte by byte.

Lanes of a batch (runs of ``LANE`` end positions of a document) are moved through
the tables in lockstep as arrays. Patterns of other lengths have tables of their
own, so short items don't shorten the shifts of long ones.

Every word of an occurrence is hit. Documents are read whole. The benchmark is
the given query set; it is read window by window and sent to the workers in blocks
of at most ``block_patterns`` windows, each block a pass over the documents. What a
pass has found is checkpointed before the next block is sent and the last one is
dropped, so the driver holds two blocks and an executor one, however many items
there are and however long. One block, the usual case, is one pass and no checkpoint.

Defined cases: null and wordless texts have no words and no hits; items without
words never occur; rows with one item id count as one item, and so do all items with
a null id, which is an item without a name (a null in ``items``, after the others);
equal rows get equal results; columns of df named n_words, spans or items are
replaced, all others kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words as W
from gleaner.session import shared_dir

LANE = 512
BITS = 20


class Tables:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, length: int, patterns: list[bytes], items: list[list[int]]):
        """patterns: distinct, words joined by one space; items: who holds each."""
        self.m, self.b = length, min(2, length)
        self.patterns, self.items = patterns, items
        col = pa.array(patterns, pa.binary())
        at, data = W.buffers(col)
        h = W.scan(at, data, W.ALNUM, lower=True).hash.reshape(len(patterns), length)
        blocks = self.blocks(h.reshape(-1)).reshape(len(patterns), length)  # block starting at each word
        most = length - self.b + 1
        self.shift = np.full(1 << BITS, most, np.uint8 if most < 256 else np.int32)
        for j in range(most):  # block that starts at word j ends m - B - j words before the end
            np.minimum.at(self.shift, (blocks[:, j] >> np.uint64(64 - BITS)).astype(np.int64), most - 1 - j)
        last = blocks[:, most - 1]
        order = np.argsort(last, kind="stable")
        self.suffix, self.order = last[order], order
        self.words = h[order]

    def blocks(self, h: np.ndarray) -> np.ndarray:
        """Hash of the block that starts at each word (the last B - 1 are of no use)."""
        if self.b == 1:
            return W.mix(h)
        out = np.zeros(len(h), np.uint64)
        out[:-1] = W.mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(5))
        return out

    def search(self, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of all occurrences in a group of documents."""
        m, b = self.m, self.b
        none = np.zeros(0, np.int64)
        if len(w.hash) < m:
            return none, none
        block = self.blocks(w.hash)
        slot = (block >> np.uint64(64 - BITS)).astype(np.int64)
        shift = self.shift[slot]
        # lanes: block starts at which an occurrence may end, LANE of them for each lane
        lo, hi = w.first[:-1] + m - b, w.first[1:] - b + 1
        some = hi > lo
        lo, hi = lo[some], hi[some]
        if not len(lo):
            return none, none
        n = -(-(hi - lo) // LANE)
        base = np.repeat(lo, n) + LANE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        stop = np.minimum(base + LANE, np.repeat(hi, n))
        found = []
        pos = base
        while len(pos):
            s = shift[pos]
            zero = s == 0
            if zero.any():
                found.append(pos[zero])
            pos = pos + np.maximum(s, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        if not found:
            return none, none
        at = np.sort(np.concatenate(found))
        left = np.searchsorted(self.suffix, block[at], "left")
        count = np.searchsorted(self.suffix, block[at], "right") - left
        begin = np.repeat(at + b - m, count)
        bucket = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        for j in range(m):
            if not len(begin):
                break
            same = w.hash[begin + j] == self.words[bucket, j]
            begin, bucket = begin[same], bucket[same]
        pattern = self.order[bucket]
        text = w.data
        sure = np.ones(len(begin), bool)
        for i, (s, p) in enumerate(zip(begin.tolist(), pattern.tolist(), strict=True)):
            words = [text[w.start[s + j] : w.end[s + j]].tobytes() for j in range(m)]
            sure[i] = b" ".join(words).translate(W.LOWER_BYTES) == self.patterns[p]
        return begin[sure], pattern[sure]


def windows(text: str | None, width: int) -> list[tuple[int, bytes]]:
    """(length, pattern) of an item."""
    at, data = W.buffers(pa.array([text], pa.string()))
    w = W.scan(at, data, W.ALNUM, lower=True)
    raw = data.tobytes().translate(W.LOWER_BYTES)
    parts = [raw[s:e] for s, e in zip(w.start, w.end, strict=True)]
    if not parts:
        return []
    m = min(width, len(parts))
    return [(m, b" ".join(parts[i : i + m])) for i in range(len(parts) - m + 1)]


def build(found: list[tuple[int, bytes, int]]) -> list[Tables]:
    """Tables for windows (length, pattern, item number), one for each length of pattern."""
    held: dict[int, dict[bytes, list[int]]] = {}
    for m, p, number in found:
        who = held.setdefault(m, {}).setdefault(p, [])
        if not who or who[-1] != number:
            who.append(number)
    return [Tables(m, list(found), list(found.values())) for m, found in sorted(held.items())]


def _named(items: set[str | None]) -> list[str | None]:
    return sorted(items, key=lambda x: (x is None, x or ""))


def _search(batches: Iterator[pa.RecordBatch], sent, earlier: bool) -> Iterator[pa.RecordBatch]:
    """Rows (text, others) in, with n_words, spans (first word, words) and items out; those of earlier passes are added to."""
    tables, names = pickle.loads(sent.value)
    for batch in batches:
        rest = batch.num_columns - (3 if earlier else 0)
        for lo, hi, bounds, data in W.groups(batch.column(0)):
            w = W.scan(bounds, data, W.ALNUM, lower=True)
            n = hi - lo
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str | None]] = {}
            for t in tables:
                begin, pattern = t.search(w)
                if len(begin):
                    docs = np.searchsorted(w.first, begin, "right") - 1
                    for d, s, p in zip(docs.tolist(), (begin - w.first[docs]).tolist(), pattern.tolist(), strict=True):
                        spans.setdefault(d, []).append((s, s + t.m))
                        items.setdefault(d, set()).update(names[i] for i in t.items[p])
            if earlier:
                for d, (x, y) in enumerate(zip(*(batch.column(i).slice(lo, n).to_pylist() for i in (rest + 1, rest + 2)), strict=True)):
                    if x:
                        spans.setdefault(d, []).extend((s["first"], s["end"]) for s in x)
                        items.setdefault(d, set()).update(y)
            merged = [_union(spans.get(d, ())) for d in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).slice(lo, n) for i in range(rest)),
                    pa.array(w.counts, pa.int64()),
                    pa.array([[{"first": a, "end": b} for a, b in x] for x in merged], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                    pa.array([_named(items.get(d, set())) for d in range(n)], pa.list_(pa.string())),
                ],
                [*batch.schema.names[:rest], "n_words", "spans", "items"],
            )


def _union(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int, most: int) -> Iterator[tuple[list[Tables], list[str | None]]]:
    """Tables of at most ``most`` windows, and the names of their items, read item by item."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    part: list[tuple[int, bytes, int]] = []
    names: list[str | None] = []
    for r in rows.toLocalIterator():
        names.append(r.i)
        for m, p in windows(r.t, width):
            part.append((m, p, len(names) - 1))
            if len(part) >= most:
                yield build(part), names
                part, names = [], [r.i]
    yield build(part), names


def occurrences(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, block_patterns: int = 200_000) -> DataFrame:
    """df with n_words, spans of hit words and the item ids (as sorted strings) that occur."""
    context = df.sparkSession.sparkContext
    rest = [c for c in df.columns if c not in ("n_words", "spans", "items")]
    rows = df.select(F.col(text_col).cast("string").alias("__text"), *(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(rest)))
    kinds = "".join(f"__{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(rest))
    schema = f"__text string, {kinds}n_words long, spans array<struct<first: long, end: long>>, items array<string>"
    blocks = _blocks(benchmark, item_col, item_text_col, width, block_patterns)
    block, earlier = next(blocks), False
    while block is not None:
        sent = context.broadcast(pickle.dumps(block))
        rows = rows.mapInArrow(lambda b, s=sent, e=earlier: _search(b, s, e), schema)
        block, earlier = next(blocks, None), True
        if block is not None:
            shared_dir(df.sparkSession)
            rows = rows.checkpoint()
            sent.unpersist()
    return rows.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(rest)), "n_words", "spans", "items")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of ``occurrences``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.select(
        F.col(id_col).alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
