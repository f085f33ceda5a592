"""Near-duplicate join: exact Jaccard join in the metric space of shingle sets.

``1 - |x & y| / |x | y|`` is a metric. Two documents link if their similarity is
at least ``num/den`` (distance at most t). Steps:

1. Sets. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a set holds 64-bit
   hashes of the distinct k-word shingles (of the whole sequence, if it is
   shorter). Documents with equal sets become one node, named by the set's hash.
2. Pivots. Sizes are cut into classes; in a class, sets are dealt into M parts by
   hash, with M above the largest symmetric difference that two linked sets of
   the class can have, so linked sets agree in a whole part. A set near the upper
   end of its class takes part in the next class too. Where sets agree in a part,
   the smallest of them is the pivot of all. A region is a pivot and all sets that
   have it as a pivot in some part: both ends of every link share a region. Parts
   with few elements are left out as far as the counts guarantee another.
3. Sketches. A set's shingles counted in ``BUCKETS`` hash buckets keep a metric, the
   sum of maxima less minima over the sum of maxima, that is never above the sets'
   distance. So links by sketches contain all links, and both ends of a link are in
   one component of the regions' sketch links: these components are the regions that
   sets move to, each set to one. Members without a sketch link move nowhere.
4. Regions. In a region, further pivots form Voronoi cells. A set goes to the cell of
   its nearest pivot and to every cell whose pivot is at most 2t farther, so both ends
   of a link meet in a cell, and cells are joined recursively. A region too large for
   a task is split so over the cluster, in rounds: its members, in shares, are held
   against its pivots' sets, and cells that are still too large are split again. What
   fits a task goes on in memory. Where cells don't shrink, each member is compared
   with those in its triangle window: |d(x, p) - d(y, p)| <= t for all pivots p; such a
   cell, if it is larger than a task (``block`` sets, ``BYTES`` bytes), is dealt into
   pairs of blocks by hash, so that every pair of sets meets in a task of two blocks.
   Where only components are wanted, members within t of its pivots are linked to these,
   and no two of a team that such links join are compared: a family costs what it has.
   Regions of sketches are split in the same way, by the sketches' metric.
5. A task counts for each set the copies of the sets it links to, every link in one
   cell only, and gives the links that join two trees, from which components are found.
   A document's links are those of its set and the other copies of its own. Links are
   counted, not listed: a family of n sets has up to n * n of them.

All comparisons are exact on 64-bit shingle hashes; nothing is sampled or capped.
Many copies of a text meet in one node before any comparison.

Defined cases: null and wordless texts have no shingles and link to nothing, not
even each other; equal ids with different texts are documents of their own; a null
id is kept, and a component of null ids alone has a null id; an empty table gives
an empty result; other columns are ignored by ``join``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words as W
from gleaner.llm.components import components
from gleaner.session import release, shared_dir

BUCKETS = 512
#: A block of sets holds about so many bytes at most, unless one set alone is larger.
BYTES = 1 << 25
#: Pivots of a region that is split over the cluster, and rounds of that.
PIVOTS, ROUNDS = 8, 12
#: 64-bit words of the filter that is sent to all executors to pick texts: 16 MB, however many texts are wanted.
FILTER = 1 << 21
#: Sketches held against others at once, and counts that are compared in unary.
RUN, UNARY = 256, 12


@dataclass(frozen=True)
class Law:
    """k-word shingles; linked when den * common >= num * union."""

    k: int = 5
    num: int = 80
    den: int = 100
    ratio: float = 1.25

    @property
    def share(self) -> float:
        return self.num / self.den


@lru_cache
def classes(law: Law) -> tuple[list[int], list[int], list[int], list[int]]:
    """Lower ends of the size classes, and for each: parts, largest difference, least size of a part."""
    if not 0.7 <= law.share < 1:
        raise ValueError("a similarity from 0.7 to below 1 is meant here")
    low, parts, differ, least = [1], [], [], []
    while low[-1] < 1 << 40:
        # wide enough that linked sets are in one class or in neighbours
        low.append(max(low[-1] + 1, math.ceil(low[-1] * law.ratio), -(-low[-1] * law.den // law.num)))
    for i in range(len(low) - 1):
        top = low[i + 1] - 1
        d = 2 * top * (law.den - law.num) // (law.den + law.num)
        best = (d + 1, 0)
        for q in (3, 2, 1):  # leave out parts of fewer than q elements
            for more in range(1, max(2, d // 6), max(1, d // 200)):
                m = d + 1 + more
                mean = low[i] / m
                small = m * math.exp(-mean) * sum(mean**j / math.factorial(j) for j in range(q))
                if small + 2 * math.sqrt(small) + 1 <= more:
                    best = (m, q)
                    break
            if best[1]:
                break
        parts.append(best[0])
        differ.append(d)
        least.append(best[1] or 1)
    return low[:-1], parts, differ, least


def sets(bounds: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and the places where they begin."""
    w = W.scan(bounds, data, W.SPACED, lower=True)
    h, ok = W.shingles(w, k)
    n = len(bounds) - 1
    doc = w.doc
    counts = w.counts
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        a, b = w.first[d], w.first[d + 1]
        x = np.array([0x1234567 + counts[d]], np.uint64)  # an array: scalars warn where they wrap
        for y in w.hash[a:b]:
            x = W.mix(x * np.uint64(7) + y)
        h[a], ok[a] = x[0], True
    h, doc = h[ok], doc[ok]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n + 1))


def _segment_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=s[1:])
    return s[first[1:]] - s[first[:-1]]


def names(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A signed 64-bit name of each set."""
    n = np.diff(first).astype(np.uint64)
    return W.mix(_segment_sums(W.mix(h ^ np.uint64(0x5851F42D4C957F2D)), first) + n * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def signatures(h: np.ndarray, first: np.ndarray, law: Law) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) of the parts of each set in its class or classes."""
    low, parts, differ, least = classes(law)
    size = np.diff(first)
    cls = np.searchsorted(low, size, "right") - 1
    a = W.mix(h ^ np.uint64(0xD6E8FEB86659FD93))
    b = W.mix(h + np.uint64(0xA0761D6478BD642F))
    sig, who = [], []
    for c in np.unique(cls[size > 0]):
        for target in (c, c + 1):
            pick = (cls == c) & (size > 0)
            if target > c:
                pick &= law.den * size >= law.num * low[target]
            docs = np.flatnonzero(pick)
            if not len(docs):
                continue
            m = parts[target]
            n = size[docs]
            at = np.repeat(first[docs], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            slot = np.repeat(np.arange(len(docs)), n) * m + (a[at] % np.uint64(m)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            slot, value = slot[order], b[at][order]
            cells = np.searchsorted(slot, np.arange(len(docs) * m + 1))
            count = np.diff(cells)
            key = W.mix(_segment_sums(value, cells) + np.tile(np.arange(m, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), len(docs)) + np.uint64(target))
            small = count < least[target]
            # with too many small parts, no other part is sure to be equal: then all count
            few = small.reshape(-1, m).sum(1) < m - differ[target]
            keep = ~small | ~np.repeat(few, m)
            sig.append(key[keep].view(np.int64))
            who.append(np.repeat(docs, m)[keep])
    if not sig:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(sig), np.concatenate(who)


def wanted(keys: DataFrame) -> np.ndarray:
    """A filter of fixed size over a column of 64-bit keys: three bits of one word for each."""
    bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(key, {shift}) & 63L as int))" for shift in (40, 46, 52))
    rows = keys.toDF("key").selectExpr(f"cast(key & {FILTER - 1}L as int) as word", f"{bits} as bits")
    got = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # FILTER rows at most
    out = np.zeros(FILTER, np.uint64)
    out[np.asarray(got["word"])] = np.asarray(got["bits"]).view(np.uint64)
    return out


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in a filter; all that are in it pass."""
    key = keys.view(np.uint64)
    have = words[(key & np.uint64(len(words) - 1)).astype(np.int64)]
    out = np.ones(len(keys), bool)
    for shift in (40, 46, 52):
        out &= (have >> (key >> np.uint64(shift) & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _nodes(batches: Iterator[pa.RecordBatch], law: Law, what: str, sent=None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if what in ("sketches", "sets"):
            batch = batch.filter(pa.array(passes(sent.value, np.asarray(batch.column(1)))))
        for lo, hi, bounds, data in W.groups(batch.column(0)):
            h, first = sets(bounds, data, law.k)
            name, size = names(h, first), np.diff(first)
            some = size > 0
            if what == "sizes":
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(name, mask=~some)], ["doc_id", "n", "node"])
            elif what == "sketches":
                doc = np.repeat(np.arange(hi - lo), size)
                slot = doc * BUCKETS + (W.mix(h + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(55)).astype(np.int64)
                counts = np.bincount(slot, minlength=(hi - lo) * BUCKETS).reshape(-1, BUCKETS)
                raw = counts.astype(np.uint8)
                # a sketch that a byte can't count is null and excludes nothing
                blobs = [raw[i].tobytes() if counts[i].max() < 256 else None for i in range(hi - lo)]
                rows = pa.RecordBatch.from_arrays([pa.array(name), pa.array(blobs, pa.binary())], ["node", "hashes"])
                yield rows.filter(pa.array(some))
            elif what == "sets":
                raw = h.tobytes()
                blobs = [raw[8 * a : 8 * b] for a, b in zip(first[:-1], first[1:], strict=True)]
                rows = pa.RecordBatch.from_arrays([pa.array(name), pa.array(blobs, pa.binary())], ["node", "hashes"])
                yield rows.filter(pa.array(some))
            else:
                _, at = np.unique(name, return_index=True)  # one of each group of copies
                one = np.zeros(len(name), bool)
                one[at] = True
                sig, who = signatures(h, first, law)
                keep = one[who] if what == "heads" else one[who] & passes(sent.value, sig)
                sig, node = sig[keep], name[who[keep]]
                if what == "heads":  # of all that share a signature here, the ends
                    order = np.lexsort((node, sig))
                    sig, node = sig[order], node[order]
                    new = np.ones(len(sig) + 1, bool)
                    new[1:-1] = sig[1:] != sig[:-1]
                    ends = new[:-1] | new[1:]
                    sig, node = sig[ends], node[ends]
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node)], ["sig", "node"])


class Region:
    """Sets of one task, with exact distances, their links and the components of these."""

    LEAF, PIVOTS = 48, 8

    def __init__(self, blobs: list[bytes], law: Law, part: np.ndarray | None = None, every: bool = True):
        """part: block of each set; if given, only pairs of different blocks are wanted. every: count all links, or only find components."""
        self.law, self.t = law, 1 - law.share
        lengths = np.array([len(b) // 8 for b in blobs])
        flat = np.frombuffer(b"".join(blobs), np.uint64)
        uniq, col = np.unique(flat, return_inverse=True)
        self.size, self.first = lengths, np.concatenate(([0], np.cumsum(lengths)))
        self.col = col.astype(np.int32)
        self.mark = np.zeros(len(uniq), np.uint8)
        self.part = part
        self.every = every
        self.comp = np.arange(len(blobs))
        self.found: list[np.ndarray] = []
        self.held = 0

    def root(self, x: int) -> int:
        return int(self.comp[x])

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """The first set of each component, beside every other one of it."""
        others = np.flatnonzero(self.comp != np.arange(len(self.comp)))
        return self.comp[others], others

    def degrees(self, copies: np.ndarray, home: np.ndarray) -> np.ndarray:
        """For each set the copies of the sets it links to; a link counts where its first end is at home."""
        n = len(self.size)
        code = np.unique(np.concatenate((*self.found, np.zeros(0, np.int64))))  # met in several cells
        a, b = code // n, code % n
        a, b = a[home[a]], b[home[a]]
        return (np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)).astype(np.int64)

    def common(self, y: int, ids: np.ndarray) -> np.ndarray:
        """|y & x| for x in ids."""
        mine = self.col[self.first[y] : self.first[y + 1]]
        self.mark[mine] = 1
        n = self.size[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.first[ids] - (ends - n), n) + np.arange(ends[-1])
        s = np.zeros(len(at) + 1, np.int64)
        np.cumsum(self.mark[self.col[at]], out=s[1:])
        self.mark[mine] = 0
        return s[ends] - s[ends - n]

    def measure(self, y: int, ids: np.ndarray) -> np.ndarray:
        """Distances to y; what is within t is linked."""
        both = self.common(y, ids)
        union = self.size[y] + self.size[ids] - both
        near = self.law.den * both >= self.law.num * union
        if self.part is not None:
            near &= self.part[ids] != self.part[y]
        x = ids[near]
        x = x[x != y]
        if len(x):
            code = np.minimum(x, y) * len(self.size) + np.maximum(x, y)
            labels = np.unique(self.comp[x])
            if (labels != self.comp[y]).any():
                both_ends = np.append(labels, self.comp[y])
                self.comp[np.isin(self.comp, both_ends)] = both_ends.min()
            if self.every:
                self.found.append(code)
                self.held += len(code)
                if self.held > 8_000_000:  # met in several cells
                    self.found = [np.unique(np.concatenate(self.found))]
                    self.held = 0
        return 1 - both / union

    def join(self, ids: np.ndarray) -> None:
        if len(ids) < 2:
            return
        if len(ids) <= self.LEAF:
            return self.scan(ids, np.zeros((0, len(ids))))
        away = np.full(len(ids), 2.0)
        dist = []
        at = 0
        for _ in range(self.PIVOTS):
            d = self.measure(int(ids[at]), ids)
            dist.append(d)
            away = np.minimum(away, d)
            at = int(np.argmax(away))
            if away[at] <= self.t:
                break
        d = np.array(dist)
        cells = d <= d.min(0) + 2 * self.t + 1e-9
        if cells.sum(1).max() > 0.7 * len(ids):
            return self.scan(ids, d)
        for cell in cells:
            self.join(ids[cell])

    def scan(self, ids: np.ndarray, d: np.ndarray) -> None:
        """Compares each member with the later ones in its triangle window."""
        for i in range(len(ids) - 1):
            rest = np.arange(i + 1, len(ids))
            if len(d):
                rest = rest[(np.abs(d[:, rest] - d[:, i : i + 1]) <= self.t + 1e-9).all(0)]
            if self.part is not None:
                rest = rest[self.part[ids[rest]] != self.part[ids[i]]]
            if not self.every:
                rest = rest[self.comp[ids[rest]] != self.comp[ids[i]]]
            if len(rest):
                self.measure(int(ids[i]), ids[rest])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """Rows (p, i, j, block, node, blob, copies, home) sorted by (p, i, j, node) -> the members of each task."""
    key, members = None, []
    for batch in batches:
        for p, i, j, block, *member in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
            if (p, i, j) != key:
                if len(members) > 1:
                    yield key, members
                key, members = (p, i, j), []
            members.append((*member, block))
    if len(members) > 1:
        yield key, members


def sketch_links(sketches: np.ndarray, law: Law, part: np.ndarray | None) -> list[tuple[int, int]]:
    """Stars of the components of the pairs within t by their sketches (of different blocks, if part is given).

    The sum of minima is the product of the counts in unary, so runs of sketches of like size are held against all
    larger ones by matrix products. Counts above ``UNARY`` add the lesser of what is above: no pair within t is left out,
    and those that pass are compared exactly.
    """
    size = sketches.sum(1, dtype=np.int64)
    order = np.argsort(size, kind="stable")
    h, size = sketches[order], size[order]
    block = None if part is None else part[order]
    comp = np.arange(len(size))
    tops = np.searchsorted(size, size * law.den // law.num, "right")
    for lo in range(0, len(size), RUN):
        hi = min(lo + RUN, len(size))
        top = int(tops[hi - 1])
        if (comp[lo:top] == comp[lo]).all():
            continue
        levels = min(int(h[lo:hi].max()), UNARY)
        rest = h[lo:top]
        unary = np.concatenate([rest > v for v in range(levels)], 1).astype(np.float32)
        both = (unary[: hi - lo] @ unary.T).astype(np.int64)
        over = np.maximum(rest, levels).sum(1, dtype=np.int64) - levels * BUCKETS
        exact = not over[: hi - lo].any()
        if not exact:
            both += np.minimum(over[: hi - lo, None], over)
        near = (law.den + law.num) * both >= law.num * (size[lo:hi, None] + size[lo:top])
        if block is not None:
            near &= block[lo:hi, None] != block[lo:top]
        for a in (lo + np.flatnonzero(near.sum(1) > (block is None))).tolist():
            found = lo + np.flatnonzero(near[a - lo])
            found = found[(found > a) & (comp[found] != comp[a])]
            if not exact and len(found):
                common = np.minimum(h[a], h[found]).sum(1, dtype=np.int64)
                found = found[law.den * common >= law.num * (size[a] + size[found] - common)]
            for x in found.tolist():
                if comp[x] != comp[a]:
                    comp[comp == comp[x]] = comp[a]
    others = np.flatnonzero(comp != np.arange(len(comp)))
    return list(zip(order[comp[others]].tolist(), order[others].tolist(), strict=True))


def _near(batches: Iterator[pa.RecordBatch], law: Law) -> Iterator[pa.RecordBatch]:
    """Each task's sketches -> links by sketches."""
    out: list[tuple[int, int]] = []
    for key, members in _runs(batches):
        nodes, blobs, _, _, block = zip(*members, strict=True)
        if None in blobs:
            out.extend((nodes[0], x) for x in nodes[1:])
        else:
            sketches = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, BUCKETS)
            out.extend((nodes[x], nodes[y]) for x, y in sketch_links(sketches, law, None if key[1] == key[2] else np.array(block)))
        if len(out) > 8192:
            yield _pairs(out)
    if out:
        yield _pairs(out)


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    rows = pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
    out.clear()
    return rows


def _regions(batches: Iterator[pa.RecordBatch], law: Law, every: bool) -> Iterator[pa.RecordBatch]:
    """Each task's sets -> stars (a, b, 0) of its components, and (a, null, copies linked to) for each set."""
    for key, members in _runs(batches):
        nodes, blobs, copies, home, block = zip(*members, strict=True)
        region = Region(list(blobs), law, None if key[1] == key[2] else np.array(block), every)
        # sorted by node: of two ends the first is the smaller node; the smallest is the first pivot
        node = np.array(nodes)
        region.join(np.arange(len(node)))
        a, b = region.stars()
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(np.zeros(len(a), np.int64))], ["a", "b", "n"])
        if every:
            n = region.degrees(np.array(copies), np.array(home, bool))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.nulls(len(some), pa.int64()), pa.array(n[some])], ["a", "b", "n"])


def _distances(what: str, pivots: list[np.ndarray], x: np.ndarray, law: Law) -> tuple[np.ndarray, np.ndarray]:
    """Exact distances of a set, or of a sketch, to others; which of them are within t."""
    if what == "sets":
        low = np.array([np.count_nonzero(p[np.minimum(np.searchsorted(p, x), len(p) - 1)] == x) for p in pivots])
        high = np.array([len(p) for p in pivots]) + len(x) - low
    else:
        each = np.array(pivots)
        low, high = np.minimum(each, x).sum(1, dtype=np.int64), np.maximum(each, x).sum(1, dtype=np.int64)
    return 1 - low / high, law.den * low >= law.num * high


def _cells(batches: Iterator[pa.RecordBatch], law: Law, what: str) -> Iterator[pa.RecordBatch]:
    """Rows (p, salt, k, node, home, blob) sorted so that a share's pivots (k >= 0) come first -> (p, k, node, home, near, to).

    A member is in the cell of its nearest pivot, its home, and in those within 2t of that. Both
    ends of a link are in the home of either, so one cell of all that they share counts as its place.
    One row of each member, that of its nearest pivot, is marked as near and has the pivots that it links to.
    """
    kind = np.uint64 if what == "sets" else np.uint8
    key, live, heads, pivots = None, [], [], []
    window = 2 * (1 - law.share) + 1e-9
    for batch in batches:
        out: list[tuple[int, int, int, bool, bool, list[int]]] = []
        for p, salt, k, node, home, blob in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
            if (p, salt) != key:
                key, live, heads, pivots = (p, salt), [], [], []
            if k >= 0:
                if blob is not None:
                    live.append(k)
                    heads.append(node)
                    pivots.append(np.frombuffer(blob, kind))
            elif blob is None or not live:  # nothing is known of it: it goes everywhere
                out.extend((p, c, node, home and i == 0, i == 0, []) for i, c in enumerate(live or [0]))
            else:
                d, linked = _distances(what, pivots, np.frombuffer(blob, kind), law)
                near = int(np.argmin(d))
                to = [heads[c] for c in np.flatnonzero(linked).tolist()]
                out.extend((p, live[c], node, home and c == near, c == near, to if c == near else []) for c in np.flatnonzero(d <= d[near] + window).tolist())
        columns = zip(*out, strict=True) if out else ((),) * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["p", "k", "node", "home", "near", "to"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (p, lists of pivots that one member links to) -> (p, first of a list, number of its group, first pivot of the group).

    Lists with a pivot in common are one group. A region has ``PIVOTS`` pivots, so few lists.
    """
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        for p, lists in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
            found: list[set[int]] = []
            for x in map(set, lists):
                found = [g for g in found if not g & x] + [x.union(*(g for g in found if g & x))]
            found.sort(key=min)
            out.extend((p, first, i, min(g)) for i, g in enumerate(found) for first in sorted({x[0] for x in lists} & g))
        columns = zip(*out, strict=True) if out else ((),) * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["p", "first", "team", "head"])


def split(members: DataFrame, blobs: DataFrame, law: Law, what: str, block: int, teams: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Members (p, node, bytes, home) of regions -> the same of Voronoi cells that fit a task or don't shrink, with a column team.

    teams: only components are wanted. Then the links of members to the pivots of a region that doesn't shrink are given
    as the second table (a, b), and members that they join are a team, of which no two need to be compared. Others are in team -1.
    """
    done, now, stars = [], members, None
    alone = F.lit(-1).alias("team")
    for level in range(ROUNDS):
        count = now.groupBy("p").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("total"))
        big = count.where((F.col("size") > 2 * block) | (F.col("total") > 2 * BYTES)).where("size > 2").checkpoint()
        if big.isEmpty():
            break
        done.append(now.join(big.select("p"), "p", "left_anti").select("p", "node", "bytes", "home", alone))
        now = now.join(big.select("p", "size"), "p")
        # pivots are the members of least hash, so that any cluster may have one; shares of a region hold about ``block`` members
        least = [F.min(F.struct(F.xxhash64("node", F.lit(f"{level}:{j}")), "node"))["node"] for j in range(PIVOTS)]
        chosen = now.groupBy("p", "size").agg(F.array_distinct(F.array(*least)).alias("nodes"))
        shares = F.ceil(F.col("size") / block).cast("int")
        pivots = chosen.select("p", "size", F.posexplode("nodes").alias("k", "node")).select("p", F.explode(F.sequence(F.lit(0), shares - 1)).alias("salt"), "k", "node", F.lit(False).alias("home"))
        each = now.select("p", F.pmod(F.xxhash64("node"), shares).cast("int").alias("salt"), F.lit(-1).alias("k"), "node", "home")
        met = pivots.unionByName(each).join(blobs, "node").select("p", "salt", "k", "node", "home", "hashes")
        met = met.repartition("p", "salt").sortWithinPartitions("p", "salt", F.desc("k"), "node")
        cells = met.mapInArrow(lambda b: W.settled(_cells(b, law, what)), "p long, k int, node long, home boolean, near boolean, to array<long>").checkpoint()
        # a region stays whole where its cells have more than half as many pairs as it has
        cell = cells.groupBy("p", "k").agg(F.count(F.lit(1)).cast("double").alias("cell"))
        dense = cell.groupBy("p").agg(F.sum(F.col("cell") * F.col("cell")).alias("pairs")).join(big, "p").where("pairs > 0.5 * size * size").select("p").checkpoint()
        whole = now.join(dense, "p", "left_semi").select("p", "node", "bytes", "home")
        if teams and not dense.isEmpty():
            linked = cells.where("near and size(to) > 0").join(dense, "p", "left_semi").select("p", "node", F.col("to")[0].alias("first"), "to").checkpoint()
            merged = linked.groupBy("p").agg(F.collect_set("to").alias("lists")).mapInArrow(_merged, "p long, first long, team int, head long").checkpoint()
            joined = linked.join(merged, ["p", "first"]).select("p", "node", "team", "head").checkpoint()
            more = joined.select(F.col("head").alias("a"), F.col("node").alias("b"))
            stars = more if stars is None else stars.unionByName(more)
            whole = whole.join(joined.select("p", "node", "team"), ["p", "node"], "left").select("p", "node", "bytes", "home", F.coalesce("team", F.lit(-1)).alias("team"))
            del linked, merged, joined, more
        else:
            whole = whole.select("*", alone)
        done.append(whole)
        fresh = cells.join(dense, "p", "left_anti").select(F.xxhash64("p", "k", F.lit(level)).alias("p"), "node", "home")
        now = fresh.join(now.select("node", "bytes").distinct(), "node").select("p", "node", "bytes", "home").checkpoint()
        del count, big, chosen, pivots, each, met, cells, cell, dense, whole, fresh
        release(now)
    now = now.select("p", "node", "bytes", "home", alone)
    for rest in done:
        now = now.unionByName(rest)
    return now.checkpoint() if done else now, stars


def tasks(cells: DataFrame, block: int) -> DataFrame:
    """Members (p, node, bytes, home, team) of cells -> rows (p, i, j, block, node, home) of tasks: a set of block b goes to (b, j) and (i, b).

    A block holds members of one team. Where that isn't -1, it meets the blocks of other teams only.
    """
    count = cells.groupBy("p", "team").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("total"))
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("total") / BYTES)).cast("int")
    dealt = count.groupBy("p").agg(F.sum("size").alias("size"), F.sum(blocks).cast("int").alias("blocks"), F.array_sort(F.collect_list(F.struct("team", blocks.alias("own")))).alias("teams")).where("size > 1")
    dealt = dealt.select("p", "blocks", "teams", F.posexplode("teams").alias("at", "each")).selectExpr("p", "blocks", "each.team as team", "each.own as own", "aggregate(slice(teams, 1, at), 0, (x, y) -> x + y.own) as before")
    placed = cells.join(dealt, ["p", "team"]).withColumn("block", F.expr("before + cast(pmod(xxhash64(node), own) as int)"))
    placed = placed.selectExpr("p", "node", "home", "block", "explode(filter(sequence(0, blocks - 1), o -> team < 0 or o < before or o >= before + own)) as o")
    return placed.select("p", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "home")


def links(df: DataFrame, sizes: DataFrame, law: Law, id_col: str, text_col: str, block: int = 1024, every: bool = True) -> DataFrame:
    """Rows (a, b, 0): pairs of nodes with the same components as all links; and, if ``every``, (a, null, n): n documents that
    have another set and link to those of node a, in parts to be added. Links of a family are counted, never listed."""
    spark = df.sparkSession
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col).alias("key"))
    # the smallest and largest node of each signature; of those in one group of texts only the ends are shuffled
    heads = rows.select("text").mapInArrow(lambda b: W.settled(_nodes(b, law, "heads")), "sig long, node long").repartition("sig")
    least = heads.groupBy("sig").agg(F.min("node").alias("p"), F.max("node").alias("q")).where("p <> q").select("sig", "p").checkpoint()
    # a filter of fixed size leaves out most signatures that no other set has
    shared = spark.sparkContext.broadcast(wanted(least.select("sig")))
    parts = rows.select("text").mapInArrow(lambda b: W.settled(_nodes(b, law, "parts", shared)), "sig long, node long")
    edges = parts.join(least, "sig").where("node <> p").select("node", "p").distinct().checkpoint()
    shared.destroy()  # else the driver and each executor keep it for as long as Python has the plan
    members = edges.unionByName(edges.select(F.col("p").alias("node"), "p").distinct())
    del heads, least, parts
    release(members)

    # tables that several plans below read are written once; else each plan would shuffle for them again
    known = sizes.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.min(F.xxhash64("doc_id")).alias("key")).checkpoint()

    def blobs(of: DataFrame, what: str) -> DataFrame:
        """(node, hashes, copies) from the texts of one document for each node."""
        picked = known.join(of.select("node").distinct(), "node", "left_semi")
        sent = spark.sparkContext.broadcast(wanted(picked.select("key")))
        # others that pass the filter go with the join on node
        found = rows.mapInArrow(lambda b: W.settled(_nodes(b, law, what, sent)), "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))
        found = found.join(known.select("node", "copies"), "node").checkpoint()
        sent.destroy()
        return found

    def dealt(of: DataFrame, what: str) -> tuple[DataFrame, DataFrame | None]:
        """Members (p, node) of regions -> rows of tasks, with their sets or sketches; links that are known without them."""
        size = F.lit(BUCKETS) if what == "sketches" else F.col("n") * 8
        held = blobs(of, what)
        placed = of.join(known, "node").select("p", "node", size.cast("long").alias("bytes"), F.lit(True).alias("home")).checkpoint()
        # every link between sets may be wanted, but of links by sketches only components are
        cells, stars = split(placed, held, law, what, block, what == "sketches" or not every)
        met = tasks(cells, block).join(held, "node").select("p", "i", "j", "block", "node", "hashes", "copies", "home")
        return met.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j", "node"), stars

    rows_near, stars = dealt(members, "sketches")
    near = rows_near.mapInArrow(lambda b: W.settled(_near(b, law)), "a long, b long")
    near = components(near if stars is None else near.unionByName(stars))
    regions = near.select(F.col("root").alias("p"), "node").unionByName(near.select(F.col("root").alias("p"), F.col("root").alias("node")).distinct()).checkpoint()
    del rows_near, stars, near
    release(regions)
    rows_met, stars = dealt(regions, "sets")
    met = rows_met.mapInArrow(lambda b: W.settled(_regions(b, law, every)), "a long, b long, n long")
    return (met if stars is None else met.unionByName(stars.withColumn("n", F.lit(0).cast("long")))).checkpoint()


def _sizes(df: DataFrame, law: Law, id_col: str, text_col: str) -> DataFrame:
    shared_dir(df.sparkSession)
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id"))
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(lambda b: W.settled(_nodes(b, law, "sizes")), f"doc_id {kind}, n long, node long").checkpoint()


def _placed(sizes: DataFrame, met: DataFrame) -> DataFrame:
    """doc_id, n, node and component_id of each row of sizes."""
    stars = components(met.where("b is not null").select("a", "b"))
    stars = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    # all but the last join are by distinct texts, and those by root only hold texts that have links
    nodes = sizes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    lowest = stars.join(nodes, "node").groupBy("root").agg(F.min("low").alias("lowest"))
    linked = stars.join(lowest, "root").select("node", "lowest")
    named = nodes.join(linked, "node", "left").select("node", F.coalesce("lowest", "low").alias("component_id"))
    full = sizes.where("n > 0").join(named, "node").select("doc_id", "n", "node", "component_id")
    return full.unionByName(sizes.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("node"), F.col("doc_id").alias("component_id")))


def join(df: DataFrame, law: Law = Law(), id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, n_links (documents it links to), component_id (smallest id of its component) for each row of df."""
    sizes = _sizes(df, law, id_col, text_col)
    met = links(df, sizes, law, id_col, text_col, block)
    copies = sizes.where("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    others = met.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    degree = copies.join(others, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    full = _placed(sizes, met).join(degree, "node", "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")


def keep_one(df: DataFrame, law: Law = Law(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked texts, that of the smallest id (null ids are the largest); columns are those of df.

    Rows are told apart by id and text, so ids may repeat with different texts: of a group's rows with its smallest id
    one stays, and rows with that id in other groups are judged there. Of rows equal in id and text one stays. Rows whose text has no words
    all stay.
    """
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"))
    marked = df.withColumn("__id", row)
    sizes = _sizes(marked, law, "__id", text_col)
    # only components are needed
    met = links(marked, sizes, law, "__id", text_col, every=False)
    found = _placed(sizes, met).where("doc_id = component_id").groupBy(F.col("doc_id.row").alias("__keep")).agg((F.count_if(F.col("n") > 0) > 1).alias("__many")).checkpoint()
    kept = df.withColumn("__row", F.xxhash64(id_col, text_col)).join(found, F.col("__row") == F.col("__keep"))
    # only rows that have an equal one are compared; the texts of the rest are not shuffled for it
    again = kept.where("__many").dropDuplicates(["__row"])
    return kept.where("not __many").select(*df.columns).unionByName(again.select(*df.columns))
