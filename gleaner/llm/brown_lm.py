"""Class-based bigram language model with exchange clustering, spread over the cluster.

Tokens of a text are its words (``[^\\x20\\x09-\\x0D]+``, A-Z in lower case) and one end;
the end also stands before the first word. All training rows are read, nothing is
sampled, and every word seen gets a class:

1. Counts of all words, with partial sums in each task, as a distributed table.
2. Context words: the ``contexts`` most frequent words. A token's context is the
   class of the word before it, one class for all other words before it (the tail),
   or the end's own class. Counts of pairs with a context word go, pre-aggregated in
   packed blocks and in two levels, into a distributed table that holds, for each
   context word, what follows it and what precedes it.
3. Exchange clustering. In each sweep every context word is offered all classes; it
   goes where the likelihood of the class bigrams gains most, judged by the class
   counts without the word itself. A sweep moves every other word (the halves take
   turns), is a narrow pass over the table of step 2, and is kept only if the
   likelihood, counted anew, has grown. Sweeps end when neither half gains a hundredth of
   what all have gained.
4. Placement. Every other word, however rare, is offered all classes in the same
   way, by the classes before and after all its occurrences.

The model:  P(w | v) = mix * P(class(w) | context(v)) * P(w | class(w)) + (1 - mix) * base(w)
with transitions smoothed by class frequency and emissions by count. Unseen words are
one type in a class of its own; as many tokens as there are words seen once (the
Good-Turing estimate of what is unseen) are added for it, in every context. Here
base(w) = (c + 1) / (N + V + 1). Over known words and the unknown type it sums to 1.

What goes to the driver or to all executors: context words and the most frequent of
the others (``contexts`` and ``table`` entries at most), and class counts (a square of
the classes). The table only saves the join below: a word gets the same probability
through either. All other words go, counted by document, through a join with the
table of placed words.

Defined cases: a null or wordless text is one end; without training rows all words
are unknown; null ids train; equal rows each count and score; ties in count go by
the word's hash, ties in gain to the lower class; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words as W
from gleaner.session import shared_dir

END = np.uint64(0x0E4D0E4D0E4D0E4D)
BLOCKS = 1024
HOLD = 3_000_000
_LOW = (1 << 20) - 1


@dataclass(frozen=True)
class Size:
    """contexts: words whose classes are contexts (below 2**20); table: other words sent along to save a join."""

    contexts: int = 65_536
    classes: int = 128
    table: int = 400_000
    sweeps: int = 8
    mix: float = 0.95
    strength: float = 50.0


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a group of documents, ends included, and where each document begins."""
    w = W.scan(bounds, data, W.SPACED, lower=True)
    n = len(bounds) - 1
    first = w.first + np.arange(n + 1)
    out = np.full(len(w.hash) + n, END, np.uint64)
    out[np.arange(len(w.hash)) + w.doc] = w.hash
    return out, first


class Sums:
    """Counts by code: sorted distinct codes with their sums, merged as they come."""

    def __init__(self):
        self.codes, self.counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.held = self.settled = 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.codes.append(codes)
        self.counts.append(counts)
        self.held += len(codes)
        if self.held > self.settled + HOLD:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = np.concatenate(self.codes), np.concatenate(self.counts)
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        new = np.ones(len(codes), bool)
        new[1:] = codes[1:] != codes[:-1]
        heads = np.flatnonzero(new)
        codes = codes[heads]
        counts = np.add.reduceat(counts, heads) if len(heads) else counts
        self.codes, self.counts = [codes], [counts]
        self.held = self.settled = len(codes)
        return codes, counts

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.settle()
        self.__init__()
        return out


def _count(batches: Iterator[pa.RecordBatch], most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    sums = Sums()

    def rows() -> pa.RecordBatch:
        words, counts = sums.take()
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts)], ["word", "c"])

    for batch in batches:
        for _, _, bounds, data in W.groups(batch.column(0)):
            u, c = np.unique(tokens(bounds, data)[0].view(np.int64), return_counts=True)
            sums.add(u, c)
            if sums.settled > most:
                yield rows()
    if sums.held:
        yield rows()


@dataclass
class Table:
    """Words by hash, each with a number (context words: by falling count)."""

    words: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray) -> Table:
        order = np.argsort(words)
        return cls(words[order], order.astype(np.int32))

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for others."""
        if not len(self.words):
            return np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.number[at], np.int32(-1))


def _blocks(sums: Sums) -> Iterator[pa.RecordBatch]:
    """What sums hold, in packed blocks by the first word of the code."""
    codes, counts = sums.take()
    block = (codes >> 20) % BLOCKS
    order = np.argsort(block, kind="stable")
    ends = np.searchsorted(block[order], np.arange(BLOCKS + 1))
    codes, counts = codes[order], counts[order]
    some = np.flatnonzero(np.diff(ends))
    spans = [(int(ends[b]), int(ends[b + 1])) for b in some]
    yield pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int32)), pa.array([codes[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())],
        ["block", "codes", "counts"],
    )


def _pairs(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Counts of (word << 20 | next word) with a context word at one end at least; others are the tail."""
    table: Table = pickle.loads(sent.value)
    tail = len(table.words)
    sums = Sums()
    for batch in batches:
        for _, _, bounds, data in W.groups(batch.column(0)):
            h, first = tokens(bounds, data)
            if not len(h):
                continue
            sym = table.look_up(h).astype(np.int64)
            sym[sym < 0] = tail
            before = np.concatenate((sym[-1:], sym[:-1]))
            before[first[:-1]] = table.look_up(np.array([END]))[0]
            some = (before < tail) | (sym < tail)
            u, c = np.unique(before[some] << 20 | sym[some], return_counts=True)
            sums.add(u, c)
            if sums.settled > HOLD:
                yield from _blocks(sums)
    if sums.held:
        yield from _blocks(sums)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[Sums]:
    """Sorted rows (block, codes, counts) -> the sums of each block."""
    key, sums = None, Sums()
    for batch in batches:
        for block, codes, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if block != key:
                if sums.held:
                    yield sums
                key, sums = block, Sums()
            sums.add(np.frombuffer(codes, np.int64), np.frombuffer(counts, np.int64))
    if sums.held:
        yield sums


def _both_ways(batches: Iterator[pa.RecordBatch], tail: int) -> Iterator[pa.RecordBatch]:
    """Merged pairs as (word << 20 | other) << 1 | direction, for either end that is a context word."""
    out = Sums()
    for sums in _merged(batches):
        codes, counts = sums.take()
        a, b = codes >> 20, codes & _LOW
        for first, second, way in ((a, b, 0), (b, a, 1 << 41)):
            own = first < tail
            out.add(way | first[own] << 20 | second[own], counts[own])
        if out.settled > HOLD:
            yield from _blocks(out)
    if out.held:
        yield from _blocks(out)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each context word: what follows it and what precedes it."""
    for sums in _merged(batches):
        codes, counts = sums.take()
        left = codes >> 41
        word, other = codes >> 20 & _LOW, (codes & _LOW).astype(np.int32)
        order = np.lexsort((left, word))
        word, other, counts, left = word[order], other[order], counts[order], left[order]
        names = np.unique(word)
        lo, hi = np.searchsorted(word, names), np.searchsorted(word, names, "right")
        mid = np.searchsorted(word * 2 + left, names * 2 + 1)
        cells = [[x[a:b].tobytes() for a, b in zip(s, e, strict=True)] for s, e in ((lo, mid), (mid, hi)) for x in (other, counts)]
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *(pa.array(c, pa.binary()) for c in cells)], ["word", "after", "after_n", "before", "before_n"])


def _contexts(batch: pa.RecordBatch, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, counts of classes after them, before them) of rows of the context table."""
    n = batch.num_rows
    out = []
    for i in (1, 3):
        at, raw = W.buffers(batch.column(i))
        places, raw_n = W.buffers(batch.column(i + 1))
        other = np.frombuffer(raw[at[0] : at[-1]].tobytes(), np.int32)
        count = np.frombuffer(raw_n[places[0] : places[-1]].tobytes(), np.int64)
        row = np.repeat(np.arange(n), np.diff(at) // 4)
        out.append(np.bincount(row * k + classes[other], count, n * k).reshape(n, k))
    return np.asarray(batch.column(0)).astype(np.int64), *out


def best_class(after: np.ndarray, before: np.ndarray, m: np.ndarray, own: np.ndarray | None, free: int) -> np.ndarray:
    """The class, of the first ``free``, in which a word with these contexts raises the class bigrams' likelihood most.

    after, before: counts of classes after and before each word. m: counts of class
    pairs. own: classes the words are in, whose counts are taken without them.
    """
    eps = 0.1

    def log(x: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(x, 0) + eps)

    total = after.sum(1)
    out_n, in_n = m.sum(1)[:free], m.sum(0)[:free]
    gain = after @ log(m[:free]).T + before @ log(m[:, :free]) - total[:, None] * (log(out_n) + log(in_n))
    if own is not None:
        rows = np.flatnonzero(own < free)
        c, a, b = own[rows], after[rows], before[rows]
        stay = (a * log(m[c] - a)).sum(1) + (b * log(m[:, c].T - b)).sum(1)
        stay -= total[rows] * (log(out_n[c] - total[rows]) + log(in_n[c] - b.sum(1)))
        gain[rows, c] = stay
    return np.argmax(gain, 1)


def _moves(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    classes, m, half, fixed, free = pickle.loads(sent.value)
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            word, after, before = _contexts(batch.slice(lo, 1024), classes, len(m))
            own = classes[word]
            to = best_class(after, before, m, own, free)
            pick = (to != own) & (word != fixed) & ((word * 0x9E3779B1 >> 7) % 2 == half)
            yield pa.RecordBatch.from_arrays([pa.array(word[pick].astype(np.int32)), pa.array(to[pick].astype(np.int32))], ["word", "class"])


def _class_pairs(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    classes, k, tail_class = pickle.loads(sent.value)
    m = np.zeros((k, k))
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            word, after, before = _contexts(batch.slice(lo, 1024), classes, k)
            np.add.at(m, classes[word], after)
            np.add.at(m[tail_class], classes[word], before[:, tail_class])
    a, b = np.nonzero(m)
    yield pa.RecordBatch.from_arrays([pa.array(a * k + b), pa.array(m[a, b].astype(np.int64))], ["pair", "c"])


def likelihood(m: np.ndarray) -> float:
    """The class bigrams' part of the log-likelihood that depends on the classes."""

    def f(x: np.ndarray) -> float:
        return float((x * np.log(np.maximum(x, 1e-12))).sum())

    return f(m) - f(m.sum(0)) - f(m.sum(1))


def exchange(rows: DataFrame, n: int, end: int, size: Size) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the n context words and the tail, counts of class pairs, and the likelihood after each kept sweep.

    The end has class ``size.classes`` to itself, the tail the one after it.
    """
    spark = rows.sparkSession
    k = size.classes + 2
    classes = (np.arange(n + 1) % size.classes).astype(np.int64)
    classes[n] = size.classes + 1
    if n:
        classes[end] = size.classes

    def counted(c: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(pickle.dumps((c, k, size.classes + 1)))
        m = np.zeros(k * k)
        got = rows.mapInArrow(lambda b: _class_pairs(b, sent), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()  # k * k rows at most
        m[np.asarray(got["pair"])] = np.asarray(got["c"])
        sent.unpersist()
        return m.reshape(k, k)

    m = counted(classes)
    history = [likelihood(m)]
    idle = 0
    for sweep in range(2 * size.sweeps):
        sent = spark.sparkContext.broadcast(pickle.dumps((classes, m, sweep % 2, end, size.classes)))
        got = rows.mapInArrow(lambda b, s=sent: _moves(b, s), "word int, class int").toArrow()  # n rows at most
        sent.unpersist()
        new = classes.copy()
        new[np.asarray(got["word"])] = np.asarray(got["class"])
        after = counted(new) if got.num_rows else m
        grown = likelihood(after) - history[-1]
        if grown > 0:
            classes, m = new, after
            history.append(history[-1] + grown)
        idle = 0 if grown > 1e-2 * abs(history[-1] - history[0]) else idle + 1
        if idle == 2:
            break
    return classes, m, history


def _around(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """(word, code, count) of words that are no context words; code: class before, or k + class after."""
    table, classes, k = pickle.loads(sent.value)
    tail = len(table.words)
    for batch in batches:
        words, codes = [], []
        for _, _, bounds, data in W.groups(batch.column(0)):
            h, first = tokens(bounds, data)
            if not len(h):
                continue
            at = table.look_up(h)
            cls = classes[np.where(at >= 0, at, tail)]
            before = np.concatenate((cls[-1:], cls[:-1]))
            before[first[:-1]] = k - 2
            rare = np.flatnonzero(at < 0)  # never an end, so a token follows
            words += [h[rare], h[rare]]
            codes += [before[rare], k + cls[rare + 1]]
        if words:
            word, code = np.concatenate(words).view(np.int64), np.concatenate(codes)
            order = np.lexsort((code, word))
            word, code = word[order], code[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (code[1:] != code[:-1])
            heads = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[heads]), pa.array(code[heads].astype(np.int32)), pa.array(np.diff(np.append(heads, len(word))))], ["word", "code", "c"]
            )


def _place(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Rows sorted by word -> (word, class, count); at the end (null, class before * k + class, count) sums."""
    m, free = pickle.loads(sent.value)
    k = len(m)
    into = np.zeros((k, k), np.int64)
    open_word, open_sums = None, np.zeros((1, 2 * k))

    def done(words: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        before, after = sums[:, :k], sums[:, k:]
        cls = best_class(after, before, m, None, free)
        np.add.at(into.T, cls, before.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(cls.astype(np.int32)), pa.array(before.sum(1).astype(np.int64))], ["word", "class", "c"])

    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            word, code, c = (np.asarray(part.column(i)) for i in range(3))
            names, at = np.unique(word, return_inverse=True)
            sums = np.bincount(at * (2 * k) + code, c, len(names) * 2 * k).reshape(len(names), 2 * k)
            if open_word is not None:
                if names[0] == open_word:
                    sums[0] += open_sums[0]
                else:
                    yield done(np.array([open_word]), open_sums)
            open_word, open_sums = names[-1], sums[-1:].copy()
            if len(names) > 1:
                yield done(names[:-1], sums[:-1])
    if open_word is not None:
        yield done(np.array([open_word]), open_sums)
    a, b = np.nonzero(into)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array((a * k + b).astype(np.int32)), pa.array(into[a, b])], ["word", "class", "c"])


@dataclass
class Model:
    """Context words are numbered first in ``table``; ``classes`` and ``counts`` are by number."""

    table: Table
    contexts: int
    classes: np.ndarray
    counts: np.ndarray
    transitions: np.ndarray  # context class, class (the last one: unknown words)
    totals: np.ndarray  # tokens of each class
    n: int
    v: int
    mix: float

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 1.0) / (self.n + self.v + 1.0)

    def probability(self, before: np.ndarray, cls: np.ndarray, c: np.ndarray) -> np.ndarray:
        """P of words of class ``cls`` and count ``c`` (0: unknown) after contexts of class ``before``."""
        own = np.where(c > 0, c / np.maximum(self.totals[cls], 1), 1.0)
        return self.mix * self.transitions[before, cls] * own + (1 - self.mix) * self.base(c)


@dataclass
class Fitted:
    model: Model
    placed: DataFrame  # word, class, c of all words that are no context words
    likelihoods: list[float]


def _top(counts: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The words of counts whose count is above a limit, so that they are ``most`` at most, by bands; and the limit."""
    bands = counts.groupBy(F.floor(F.log2("c") * 8).alias("b")).agg(F.count(F.lit(1)).alias("v"), F.min("c").alias("low")).orderBy(F.desc("b")).collect()
    cut, held = 1 << 62, 0
    for r in bands:
        if held + r.v > most:
            break
        held, cut = held + r.v, r.low
    return counts.where(F.col("c") >= cut), cut


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: Size = Size()) -> Fitted:
    """Learns from the rows of docs that aren't held out."""
    spark = docs.sparkSession
    context = spark.sparkContext
    shared_dir(spark)
    k = size.classes + 2
    rows = docs.where(~held_out(id_col)).select(F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(_count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")).checkpoint()
    n, v, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(F.col("c") == 1, 1))).first()
    # the most frequent words; the end is always one of them
    is_end = F.col("word") == int(END.view(np.int64))
    top = counts.orderBy(F.desc(is_end), F.desc("c"), "word").limit(size.contexts).toArrow()
    words = np.array(top["word"]).view(np.uint64)
    own = np.array(top["c"])
    table = Table.of(words)
    sent = context.broadcast(pickle.dumps(table))
    # pairs, merged in two levels: by block and part of the input, then by block
    packed = rows.mapInArrow(lambda b: _pairs(b, sent), "block int, codes binary, counts binary")
    parted = packed.withColumn("part", F.spark_partition_id() % 8).repartition("block", "part").sortWithinPartitions("block", "part").select("block", "codes", "counts")
    tail = len(words)
    both = parted.mapInArrow(lambda b: _both_ways(b, tail), "block int, codes binary, counts binary")
    whole = both.repartition("block").sortWithinPartitions("block")
    by_word = whole.mapInArrow(_word_rows, "word int, after binary, after_n binary, before binary, before_n binary").checkpoint()
    classes, m, history = exchange(by_word, len(words), 0, size)
    # all other words are placed by the classes around them
    known = context.broadcast(pickle.dumps((table, classes, k)))
    state = context.broadcast(pickle.dumps((m, size.classes)))
    around = rows.mapInArrow(lambda b: _around(b, known), "word long, code int, c long").repartition("word").sortWithinPartitions("word")
    placed = around.mapInArrow(lambda b: _place(b, state), "word long, class int, c long").checkpoint()
    moved = placed.where("word is null").groupBy("class").agg(F.sum("c").alias("c")).toArrow()  # k * k rows at most
    placed = placed.where("word is not null")
    # transitions from contexts to classes; a column more for unknown words
    into = np.zeros((k, k))
    into[:, : k - 1] = m[:, : k - 1]
    np.add.at(into.reshape(-1), np.asarray(moved["class"]).astype(np.int64), np.asarray(moved["c"]))
    unknown = max(1, once)
    into[:, k - 1] = unknown * into.sum(1) / max(into.sum(), 1)
    prior = into.sum(0) + (np.arange(k) == k - 1)
    prior = prior / prior.sum()
    transitions = (into + size.strength * prior) / (into.sum(1, keepdims=True) + size.strength)
    # the most frequent of the others go with the model
    frequent, cut = _top(placed, size.table)
    got = frequent.select("word", "class", "c").toArrow()
    all_words = np.concatenate((words, np.array(got["word"]).view(np.uint64)))
    all_classes = np.concatenate((classes[:-1], np.asarray(got["class"]).astype(np.int64)))
    all_counts = np.concatenate((own, np.asarray(got["c"])))
    totals = into.sum(0)
    model = Model(Table.of(all_words), len(words), all_classes, all_counts, transitions, totals, n, v, size.mix)
    return Fitted(model, placed.where(F.col("c") < cut), history)


def _score(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    m: Model = pickle.loads(sent.value)
    k = len(m.transitions)
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for lo, hi, bounds, data in W.groups(batch.column(0)):
            h, first = tokens(bounds, data)
            n = hi - lo
            at = m.table.look_up(h)
            cls = m.classes[at] if len(m.classes) else np.zeros(len(h), np.int64)
            context = np.where((at >= 0) & (at < m.contexts), cls, k - 1)
            before = np.concatenate((context[-1:], context[:-1]))
            before[first[:-1]] = k - 2
            doc = np.repeat(np.arange(n), np.diff(first))
            known = at >= 0
            base, score = np.zeros(n), np.zeros(n)
            if known.any():
                c = m.counts[at[known]]
                base = np.bincount(doc[known], np.log10(m.base(c)), n)
                score = np.bincount(doc[known], np.log10(m.probability(before[known], cls[known], c)), n)
            rare = np.flatnonzero(~known)
            order = rare[np.lexsort((before[rare], h[rare], doc[rare]))]
            new = np.ones(len(order), bool)
            if len(order):
                new[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1]) | (before[order][1:] != before[order][:-1])
            heads = np.flatnonzero(new)
            times = np.diff(np.append(heads, len(order)))
            pick = order[heads]
            ends = pa.array(np.searchsorted(doc[pick], np.arange(n + 1)), pa.int32())

            def nested(values: np.ndarray, ends=ends) -> pa.Array:
                return pa.ListArray.from_arrays(ends, pa.array(values))

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)), batch.column(1).slice(lo, n), batch.column(2).slice(lo, n), pa.array(np.diff(first).astype(np.int64)),
                    pa.array(np.bincount(doc[known], minlength=n).astype(np.int64)), pa.array(base), pa.array(score),
                    nested(h[pick].view(np.int64)), nested(before[pick].astype(np.int32)), nested(times.astype(np.int64)),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "words", "befores", "times"],
            )
            row += n


def _rest(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """(row, times, class before, class, count) of joined words -> (row, known, base, score)."""
    m: Model = pickle.loads(sent.value)
    k = len(m.transitions)
    for batch in batches:
        times, before = np.asarray(batch.column(1)), np.asarray(batch.column(2))
        cls = np.asarray(batch.column(3).fill_null(k - 1))
        c = np.asarray(batch.column(4).fill_null(0))
        scores = [times * (c > 0), times * np.log10(m.base(c)), times * np.log10(m.probability(before, cls, c))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in scores)], ["row", "k", "b", "s"])


def score(docs: DataFrame, fitted: Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) for each row."""
    m = fitted.model
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(pickle.dumps(m))
    small = context.broadcast(pickle.dumps(Model(Table.of(np.zeros(0, np.uint64)), 0, m.classes[:0], m.counts[:0], m.transitions, m.totals, m.n, m.v, m.mix)))
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, words array<long>, befores array<int>, times array<long>"
    passed = rows.mapInArrow(lambda b: _score(b, sent), schema).checkpoint()
    tail = passed.select("row", F.explode(F.arrays_zip("words", "befores", "times")).alias("x")).select("row", "x.times", "x.befores", F.col("x.words").alias("word"))
    met = tail.join(fitted.placed, "word", "left").select("row", "times", "befores", "class", "c")
    sums = met.mapInArrow(lambda b: _rest(b, small), "row long, k long, b double, s double").groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    out = passed.drop("words", "befores", "times").join(sums, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(m.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
