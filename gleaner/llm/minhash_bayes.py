"""MinHash near-duplicates with sequential Bayesian verification.

Documents link when the Jaccard similarity of their shingle sets is at least ``num/den``.

1. Nodes. Documents with equal sets are one node, named by the set's 64-bit hash.
2. Signatures. ``hashes`` minima of a set under as many permutations, 16 bits of each.
   They are cut into bands of ``rows`` minima, as many that a pair at the threshold has no
   equal band with probability ``miss`` at most. Nodes with an equal band are candidates.
3. Stars. Where nodes agree in a band, the least is the pivot of all: a node has one
   candidate a band, however large the group is.
4. Sequential verification. Signatures of a candidate pair are compared batch by batch.
   After m equal minima of n, with a uniform prior, the similarity's posterior is
   Beta(m + 1, n - m + 1); a pair leaves as soon as P(similarity >= threshold) is below
   ``doubt``. The chance that a linked pair leaves is stated by ``Plan.risk``.
5. Exact verification. Survivors are compared by their full sets; only these comparisons
   link. Components are all that is wanted, so the likeliest candidates of each node come first,
   and those whose ends are in one component by then need no comparison; rounds take sixteen
   times as many until none is left.
6. The rest of each band. Stars say nothing of two nodes neither of which links to the
   pivot. In the groups whose nodes are now in several components, every pair of different
   components is compared by signatures, batch by batch, in tasks that hold a group (a large one is
   dealt into blocks; nodes of its largest component only meet the others, never each other).
   What survives is one row for each node and group, with the list of its candidates, the likeliest first; a task
   that holds two blocks of sets compares the lists by the full sets, and no pair whose ends it has
   joined. After that no pair of an equal band is undecided.

No pair is listed within a component, so a family of n near copies costs some multiples of n. Pairs just below the threshold,
which neither link nor leave, are compared one and all, but in tasks: no join makes a row of each. What is not
exact is only the choice of pairs (``miss`` and ``risk``, both for a pair exactly at the
threshold; more similar pairs are missed far less often); nothing is sampled or capped.
64-bit hashes stand for shingles and sets.

Defined cases: null and wordless texts have no shingles and link to nothing, not even each
other; fewer words than k are one shingle; equal ids with different texts are documents of their own; a
null id is kept as it is, is the smallest of its component only where there is no other, and then counts as kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import words as W
from gleaner.llm.components import components, fitted
from gleaner.llm.pivot_join import Law, Region, _nodes, _placed, _sizes, names, passes, sets, wanted
from gleaner.session import release

_rng = np.random.Generator(np.random.PCG64(20251003))
#: Shingles that are hashed at once, so that they stay in the processor's cache.
CHUNK = 1 << 16
#: Members of a block of a large group.
BLOCK = 2048
#: Candidates that a task lists before it hands them on.
LISTED = 1 << 16


@dataclass(frozen=True)
class Plan:
    """rows of a band; miss: of a pair at the threshold by all bands; doubt: posterior below which a pair leaves."""

    law: Law = Law(k=2, num=80, den=100)
    rows: int = 6
    miss: float = 1e-6
    doubt: float = 1e-7

    @cached_property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - self.law.share**self.rows))

    @property
    def hashes(self) -> int:
        return self.rows * self.bands

    @cached_property
    def batches(self) -> list[tuple[int, int]]:
        """(n, least m): after n minima a pair stays if at least m of them are equal."""
        ends = [n for n in (32, 64, 128, 192) if n < self.hashes] + [self.hashes]
        return [(n, next(m for m in range(n + 1) if self.posterior(m, n) >= self.doubt)) for n in ends]

    def posterior(self, m: int, n: int) -> float:
        """P(similarity >= threshold) after m of n equal minima."""
        t = self.law.share
        return sum(math.exp(_choose(n + 1, j) + j * math.log(t) + (n + 1 - j) * math.log(1 - t)) for j in range(m + 1))

    @cached_property
    def risk(self) -> float:
        """Bound of the probability that a pair at the threshold leaves in some batch."""
        t = self.law.share
        return sum(math.exp(_choose(n, j) + j * math.log(t) + (n - j) * math.log(1 - t)) for n, least in self.batches for j in range(least))


def _choose(n: int, j: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)


_XOR = _rng.integers(0, 2**32, 4096, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**31, 4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(h: np.ndarray, first: np.ndarray, hashes: int) -> np.ndarray:
    """(sets, hashes) of 16 bits of the minima; no set is empty."""
    x = (W.mix(h + np.uint64(0x8E9D5A3C1F2B7641)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, hashes), np.uint16)
    lo = 0
    while lo < len(first) - 1:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + CHUNK, "right")) - 1)
        part, starts = x[first[lo] : first[hi]], first[lo:hi] - first[lo]
        for j in range(hashes):
            out[lo:hi, j] = np.minimum.reduceat((part ^ _XOR[j]) * _TIMES[j], starts).astype(np.uint16)
        lo = hi
    return out


def _signed(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """(node, sig) of each distinct set of a group of texts."""
    for batch in batches:
        for _, _, bounds, data in W.groups(batch.column(0)):
            h, first = sets(bounds, data, plan.law.k)
            name = names(h, first)
            _, at = np.unique(name, return_index=True)
            at = at[np.diff(first)[at] > 0]
            size = np.diff(first)[at]
            ends = np.cumsum(size)
            rows = np.repeat(first[at] - (ends - size), size) + np.arange(size.sum())
            raw, wide = signatures(h[rows], np.append(0, ends), plan.hashes).tobytes(), 2 * plan.hashes
            yield pa.RecordBatch.from_arrays([pa.array(name[at]), pa.array([raw[i : i + wide] for i in range(0, len(raw), wide)], pa.binary())], ["node", "sig"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures as rows of 16-bit numbers."""
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(n, -1) if n else np.zeros((0, 1), np.uint16)


def _key(sig: np.ndarray, band: int, rows: int) -> np.ndarray:
    """The key of a band of each signature (64-bit numbers)."""
    key = np.full(len(sig), band + 1, np.uint64)
    for j in range(band * rows, (band + 1) * rows):
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j])
    return key.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch], plan: Plan, sent=None) -> Iterator[pa.RecordBatch]:
    """Rows (node, sig) -> (key, node) for each band, or for those that pass the filter."""
    for batch in batches:
        sig, node = _matrix(batch.column(1)).astype(np.uint64), np.asarray(batch.column(0))
        for band in range(plan.bands if len(node) else 0):
            key = _key(sig, band, plan.rows)
            keep = passes(sent.value, key) if sent is not None else slice(None)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep])], ["key", "node"])


def _bayes(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, sig of a, sig of b) -> (a, b, equal minima) of the pairs that survive every batch."""
    for batch in batches:
        x, y = _matrix(batch.column(2)), _matrix(batch.column(3))
        alive, same, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
        for n, least in plan.batches:
            same[alive] += (x[alive, done:n] == y[alive, done:n]).sum(1)
            alive, done = alive[same[alive] >= least], n
        keep = pa.array(alive)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(same[alive])], ["a", "b", "same"])


def _lists(a: np.ndarray, b: np.ndarray, first: np.ndarray, more: dict[str, np.ndarray] | None = None) -> pa.RecordBatch:
    """(more, a, b): rows that begin at ``first``, b as lists."""
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(b)), pa.int32()), pa.array(b, pa.int64()))
    columns = {**(more or {}), "a": a}
    return pa.RecordBatch.from_arrays([*(pa.array(x[first], pa.int64()) for x in columns.values()), lists], [*columns, "b"])


def _groups(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, block, node, comp, sig) sorted by (key, i, j) -> (a, list of b, the likeliest first): pairs of different components (and blocks, where i <> j) that survive every batch."""

    def compare(key: tuple, members: list[tuple]) -> Iterator[pa.RecordBatch]:
        block, node, comp, head = zip(*members, strict=True)
        if len(node) < 2:
            return
        part, node, comp = np.array(block), np.array(node), np.array(comp)
        x = np.frombuffer(b"".join(head), np.uint16).reshape(len(node), -1)
        apart = key[1] != key[2]
        # a pair that agrees in several bands is told by the group of the first one
        bands, one = x.reshape(len(x), -1, plan.rows), x[:1].astype(np.uint64)
        mine = next(band for band in range(plan.bands) if _key(one, band, plan.rows)[0] == key[0])
        found, held = [], 0
        for r in range(len(node) - 1):
            rest = r + 1 + np.flatnonzero((comp[r + 1 :] != comp[r]) & ((part[r + 1 :] != part[r]) | (not apart)))
            done, same = 0, np.zeros(len(rest), np.int64)
            for n, least in plan.batches:
                if not len(rest):
                    break
                same += (x[rest, done:n] == x[r, done:n]).sum(1)
                rest, same, done = rest[same >= least], same[same >= least], n
            if len(rest):
                first = (bands[rest] == bands[r]).all(2).argmax(1) == mine
                rest, same = rest[first], same[first]
            if len(rest):
                found.append((node[r], node[rest[np.argsort(-same, kind="stable")]]))
                held += len(rest)
            if held >= LISTED or found and r == len(node) - 2:
                size = np.array([len(b) for _, b in found])
                yield _lists(np.repeat([a for a, _ in found], size), np.concatenate([b for _, b in found]), np.cumsum(size) - size)
                found, held = [], 0

    key, members = None, []
    for batch in batches:
        for k, i, j, *member in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            if (k, i, j) != key:
                if members:
                    yield from compare(key, members)
                key, members = (k, i, j), []
            members.append(member)
    if members:
        yield from compare(key, members)


def _new(*columns: np.ndarray) -> np.ndarray:
    """Places where sorted rows differ from the row before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.flatnonzero(out)


def _dealt(batches: Iterator[pa.RecordBatch], blocks: int, what: str) -> Iterator[pa.RecordBatch]:
    """Rows (a, list of b) -> the parts of each list by the cell of its ends' blocks: (cell, a, list of b); or the cells that need a node: (node, list of cells)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):  # lists are as long as two blocks of a group at most
            part = batch.slice(lo, 256)
            a, b = np.asarray(part.column(0)), np.asarray(part.column(1).flatten())
            a = np.repeat(a, np.asarray(pc.list_value_length(part.column(1))))
            i, j = ((W.mix(end.view(np.uint64) ^ np.uint64(0x6A09E667F3BCC909)) % np.uint64(blocks)).astype(np.int64) for end in (a, b))
            cell = np.minimum(i, j) * blocks + np.maximum(i, j)
            if what == "nodes":
                node, cell = np.concatenate((a, b)), np.tile(cell, 2)
                order = np.lexsort((cell, node))
                once = order[_new(node[order], cell[order])]
                yield _lists(node[once], cell[once], _new(node[once]))
            else:
                order = np.lexsort((a, cell))  # stable: the likeliest stay first
                a, b, cell = a[order], b[order], cell[order]
                yield _lists(a, b, _new(cell, a), {"cell": cell})


def _exact(batches: Iterator[pa.RecordBatch], law: Law) -> Iterator[pa.RecordBatch]:
    """Rows (cell, a, its component or null, list of b or null, set or null) sorted so that a cell's sets come before its lists -> linked pairs (a, b) that join components."""
    cell, held, at, region = None, [], {}, None
    for batch in batches:
        out: list[tuple[int, int]] = []
        for here, a, root, others, blob in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            if here != cell:
                cell, held, region = here, [], None
            if others is None:
                held.append((a, root, blob))
                continue
            if region is None:
                nodes, roots, blobs = zip(*held, strict=True)
                held, at, region = [], {node: k for k, node in enumerate(nodes)}, Region(list(blobs), law, every=False)
                region.comp = np.unique(np.array(roots), return_inverse=True)[1]
            y, comp, size = at[a], region.comp, region.size
            ids = np.array([at[b] for b in others])
            lo, hi = 0, 16
            while lo < len(ids):
                part = ids[lo:hi]
                part = part[comp[part] != comp[y]]
                lo, hi = hi, hi + 128
                if len(part):
                    common = region.common(y, part)
                    for x in part[law.den * common >= law.num * (size[y] + size[part] - common)].tolist():
                        if comp[x] != comp[y]:
                            comp[comp == comp[x]] = comp[y]
                            out.append((a, nodes[x]))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct nodes of rows (a, b or list of b)."""
    for batch in batches:
        a, b = batch.column(0), batch.column(1)
        nodes = np.unique(np.concatenate((np.asarray(a), np.asarray(b.flatten() if pa.types.is_list(b.type) else b))))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64())], ["node"])


def verified(pairs: DataFrame, held: DataFrame, comps: DataFrame | None, law: Law, nodes: int = 512, size: int = 1 << 24) -> DataFrame:
    """Of the pairs (a, list of b), compared by their full sets (node, hashes), links (a, b) that have the components of all that link.

    Nodes are dealt into blocks of some ``nodes`` sets and ``size`` bytes at most; a pair belongs to the cell of its ends' blocks, and a
    cell gets each set that its pairs need once, however many pairs a set is in.
    """
    total = held.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("hashes")).alias("bytes")).first()
    blocks = 1 + max(total["n"] // nodes, (total["bytes"] or 0) // size)
    lists = pairs.mapInArrow(lambda b: _dealt(b, blocks, "lists"), "cell long, a long, b array<long>")
    # a node is in some groups, and a row for each group and cell would be many more
    needed = pairs.mapInArrow(lambda b: _dealt(b, blocks, "nodes"), "a long, b array<long>").toDF("node", "cells")
    needed = needed.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set("cells"))).alias("cells"))
    root = F.col("node")
    if comps is not None:
        held, root = held.join(comps, "node", "left"), F.coalesce("root", "node")
    rows = needed.join(held, "node").select(F.explode("cells").alias("cell"), F.col("node").alias("a"), root.alias("of"), F.lit(None).cast("array<long>").alias("b"), "hashes")
    met = rows.unionByName(lists, allowMissingColumns=True).repartition("cell").sortWithinPartitions("cell", F.col("b").isNotNull())
    return met.mapInArrow(lambda b: W.settled(_exact(b, law)), "a long, b long")


def _likely(pairs: DataFrame, sigs: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) -> (a, b, same) of those that the posterior keeps."""
    left, right = sigs.select(F.col("node").alias("a"), F.col("sig").alias("x")), sigs.select(F.col("node").alias("b"), F.col("sig").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(lambda b: W.settled(_bayes(b, plan)), "a long, b long, same long").checkpoint()


def _labelled(pairs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Pairs whose ends are in different components."""
    if comps is None:
        return pairs
    for end in ("a", "b"):
        pairs = pairs.join(comps.select(F.col("node").alias(end), F.col("root").alias(f"of_{end}")), end, "left")
    return pairs.where("coalesce(of_a, a) <> coalesce(of_b, b)").drop("of_a", "of_b")


def _settle(pairs: DataFrame, links: DataFrame | None, comps: DataFrame | None, held: DataFrame, law: Law, lists: bool = False) -> tuple[DataFrame | None, DataFrame | None]:
    """Compares pairs (a, b, same) by their sets until every pair is compared or in one component; links and components with those before.

    lists: pairs are (a, list of b), the likeliest first, of different components; one round, and the components stay as they were.
    """
    if lists:
        fresh = verified(pairs, held, comps, law)
        return (fresh if links is None else links.unionByName(fresh)).checkpoint(), comps
    take, now = 1, _labelled(pairs, comps)  # then 16, then all but those whose ends have met: three rounds at most for pairs of stars
    while True:
        # a pair belongs to its larger end; its likeliest pairs come first
        ranked = now.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("same"), "a"))).checkpoint()
        n = ranked.count()
        if not n:
            return links, comps
        ranked = fitted(ranked, n)
        fresh = verified(ranked.where(F.col("rank") <= take).select("a", F.array("b").alias("b")), held, comps, law)
        links = (fresh if links is None else links.unionByName(fresh)).checkpoint()
        links = fitted(links, links.count())
        comps = _rooted(links)
        now, take = _labelled(ranked.where(F.col("rank") > take).drop("rank"), comps), 16 * take
        release(links)


def _rooted(links: DataFrame) -> DataFrame:
    stars = components(links)
    rooted = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()).checkpoint()
    return fitted(rooted, rooted.count())


def links(df: DataFrame, sizes: DataFrame, plan: Plan, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """Linked pairs of nodes (a, b) that have the components of all links found."""
    spark, law = df.sparkSession, plan.law
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col).alias("key"))
    sigs = rows.select("text").mapInArrow(lambda b: W.settled(_signed(b, plan)), "node long, sig binary").groupBy("node").agg(F.first("sig").alias("sig")).checkpoint()
    bands = sigs.mapInArrow(lambda b: _bands(b, plan), "key long, node long")
    shared = bands.groupBy("key").agg(F.min("node").alias("p"), F.max("node").alias("q")).where("p <> q").select("key", "p").checkpoint()
    # a filter of fixed size leaves out most bands that no other node has
    sent = spark.sparkContext.broadcast(wanted(shared.select("key")))
    members = sigs.mapInArrow(lambda b: _bands(b, plan, sent), "key long, node long").join(shared, "key").checkpoint()
    members = fitted(members, members.count())

    def held(of: DataFrame) -> DataFrame:
        """(node, hashes) of the ends of pairs (b may be a list), from the text of one document each."""
        ends = of.mapInArrow(_ends, "node long").distinct()
        picked = sizes.join(ends, "node", "left_semi").groupBy("node").agg(F.min(F.xxhash64("doc_id")).alias("key"))
        some = spark.sparkContext.broadcast(wanted(picked.select("key")))
        found = rows.mapInArrow(lambda b: W.settled(_nodes(b, law, "sets", some)), "node long, hashes binary")
        return found.join(ends, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")).checkpoint()

    stars = _likely(members.where("node <> p").select(F.col("p").alias("a"), F.col("node").alias("b")).distinct(), sigs, plan)
    found, comps = _settle(stars, None, None, held(stars), law)
    # every pair of a group's pivot is decided
    members = members.where("node <> p")
    if comps is None:
        known = members.select("key", "node", F.col("node").alias("comp"))
    else:
        known = members.join(comps, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    known = known.checkpoint()
    known = fitted(known, known.count())
    release(known)

    # groups of several components; the largest component's nodes are at side 1, all others at side 0
    count = known.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    group = count.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"), F.max("n").alias("top"), F.sum("n").alias("n")).where("top < n")
    group = group.select("key", "most", F.ceil((F.col("n") - F.col("top")) / block).cast("int").alias("others"), F.ceil(F.col("top") / block).cast("int").alias("tops"))
    placed = known.join(group, "key").withColumn("side", F.col("comp") == F.col("most"))
    # blocks 0 .. others - 1 hold the others, the next ones the largest component; no task holds two of the latter
    number = F.when(F.col("side"), F.col("others") + F.pmod(F.xxhash64("node"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    placed = placed.withColumn("block", number)
    partners = F.when(F.col("side"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("tops") - 1))
    placed = placed.select("key", "node", "comp", "block", F.explode(partners).alias("o")).select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "comp")
    met = placed.join(sigs, "node").select("key", "i", "j", "block", "node", "comp", "sig").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    rest = met.mapInArrow(lambda b: W.settled(_groups(b, plan)), "a long, b array<long>").checkpoint()
    if rest.isEmpty():
        return found if found is not None else stars.select("a", "b")
    return _settle(rest, found, comps, held(rest), law, True)[0]


def near(df: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of its component) and kept (whether that is its own) for each row of df."""
    sizes = _sizes(df, plan.law, id_col, text_col)
    full = _placed(sizes, links(df, sizes, plan, id_col, text_col, block))
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
