"""Quality by co-training of two views of a page.

The content view sees the text alone: what its words are like (repetition, symbols,
capitals, length, variety) and how it is laid out (lines, their ends, repeated ones).
The metadata view sees what is stated about the page and nothing of its text: language,
source, stated length. A logistic classifier of each view starts from the labelled
rows. In each round each view scores every unlabelled document; those of which it is
sure are pseudo-labels for the other view, and both are fitted again. Scores of both
views are calibrated on labelled rows set aside, and a logistic combination of the
calibrated views scores all documents in one pass.

Nothing is sampled: features of all documents are made once, in one pass over the
texts, as a distributed table of numbers, and every fit is by Newton steps on sums of
gradients and Hessians over that table. So the driver gets matrices of a fixed size,
however many rows, labelled or not, there are. Pseudo-labels of a class have at most
the weight of the labelled rows in that class together, and none more than a label.

Defined cases: null texts are empty, null or missing metadata are values of their
own; without labels of both kinds (20 rows at least), every document gets the score 1
and is kept (nothing is known against it); conflicting labels of an id count as the
lower one; a score of just ``threshold`` is kept; equal rows score alike; an empty
table gives none; ``keep`` returns the columns of its input.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words as W
from gleaner.llm.line_rules import MARKS, SYMBOLS, _sums, repeated_words
from gleaner.session import shared_dir

LANGS, SOURCES, LENGTHS = 8, 16, 20


@dataclass(frozen=True)
class Plan:
    """rounds of exchange; a view is sure of a label from the probability ``sure`` on."""

    rounds: int = 3
    sure: float = 0.9
    steps: int = 8
    l2: float = 1.0


def content(bounds: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Content features of each document."""
    w = W.scan(bounds, data, W.SPACED, lower=False)
    n = np.maximum(w.counts, 1).astype(float)
    lo, hi = w.first[:-1], w.first[1:]

    def per_doc(flags: np.ndarray) -> np.ndarray:
        s = _sums(flags)
        return (s[bounds[1:]] - s[bounds[:-1]]).astype(float)

    def per_words(flags: np.ndarray) -> np.ndarray:
        s = _sums(flags)
        return (s[hi] - s[lo]).astype(float)

    size = (w.end - w.start).astype(float)
    key = np.sort(W.mix(w.hash ^ W.mix(w.doc.astype(np.uint64) + np.uint64(3))))
    order = np.argsort(W.mix(w.hash ^ W.mix(w.doc.astype(np.uint64) + np.uint64(3))), kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[1:] == key[:-1]
    stutter = np.zeros(len(w.hash), bool)
    stutter[1:] = w.hash[1:] == w.hash[:-1]
    stutter[lo[lo < hi]] = False
    letters = np.maximum(per_doc(W.ALNUM[data]), 1)
    chars = np.zeros(len(size) + 1)
    np.cumsum(size, out=chars[1:])
    return np.stack(
        [
            repeated_words(w) / n,
            np.minimum(per_doc(SYMBOLS[data]) / n, 3),
            np.minimum(per_doc(data == 0x21) / n, 2),
            per_doc((data >= 0x41) & (data <= 0x5A)) / letters,
            np.log1p((chars[hi] - chars[lo]) / n),
            per_words(again) / n,
            per_words(stutter) / n,
            per_doc((data >= 0x30) & (data <= 0x39)) / letters,
            per_words(size == 1) / n,
            np.minimum(per_doc(MARKS[data]) / n, 2),
            np.log1p(w.counts),
            (w.counts < 50).astype(float),
        ],
        1,
    )


def layout(bounds: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Features of how each text is laid out, of the content view."""
    lines = W.scan(bounds, data, W.LINED, lower=False)
    n = len(bounds) - 1
    k = np.maximum(lines.counts, 1).astype(float)
    size = (lines.end - lines.start).astype(float)
    ends = np.isin(data[lines.end - 1], list(b".!?\"')")) if len(size) else np.zeros(0, bool)
    doubled = np.zeros(len(size), bool)
    if len(size):
        doubled = (size > 1) & (data[lines.end - 1] == 0x21) & (data[np.maximum(lines.end - 2, 0)] == 0x21)
    key = W.mix(lines.hash ^ W.mix(lines.doc.astype(np.uint64) + np.uint64(7)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    doc, total = lines.doc, np.maximum(np.diff(bounds), 1).astype(float)

    def each(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, x, n)

    longest = np.zeros(n)
    np.maximum.at(longest, doc, size)
    flat = [np.log1p(lines.counts), np.log1p(total / k), each(again) / k, each(size * ~ends) / total, each(doubled) / k, longest / total]
    return np.stack(flat, 1)


def metadata(lang: list, source: list, stated: list) -> np.ndarray:
    """Features of what is stated about each page: hashed language and source, and length by its powers of two."""
    n = len(lang)
    out = np.zeros((n, 2 + LANGS + SOURCES + LENGTHS))
    for i, (a, b, c) in enumerate(zip(lang, source, stated, strict=True)):
        out[i, 0] = np.log1p(max(c or 0, 0))
        out[i, 1] = c is None
        out[i, 2 + zlib.crc32((a or "").encode()) % LANGS] = 1
        out[i, 2 + LANGS + zlib.crc32((b or "").encode()) % SOURCES] = 1
        out[i, 2 + LANGS + SOURCES + min(max(c or 0, 0).bit_length(), LENGTHS - 1)] = 1
    return out


@dataclass
class Logistic:
    """Standardised logistic regression."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray

    @classmethod
    def start(cls, mean: np.ndarray, var: np.ndarray) -> Logistic:
        sd = np.sqrt(np.maximum(var, 0))
        return cls(mean, np.where(sd > 1e-9, 1 / np.maximum(sd, 1e-9), 0), np.zeros(len(mean) + 1))

    def with_one(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((np.clip((x - self.mean) * self.scale, -8, 8), np.ones((len(x), 1))), 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.with_one(x) @ self.w, -20, 20)

    def sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Gradient and Hessian of the weighted rows, as one vector."""
        z = self.with_one(x)
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
        g = z.T @ (weight * (p - y))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z
        return np.concatenate((g, h.ravel()))

    def step(self, sums: np.ndarray, l2: float) -> float:
        """A Newton step by the sums of all rows; returns the largest change."""
        d = len(self.w)
        pull = np.full(d, l2)
        pull[-1] = 1e-3
        step = np.linalg.solve(sums[d:].reshape(d, d) + np.diag(pull), sums[:d] + pull * self.w)
        self.w = self.w - np.clip(step, -4, 4)
        return float(np.abs(step).max())


@dataclass
class Model:
    """Both views, their calibrations and their combination; None: nothing is known."""

    views: tuple[Logistic, Logistic] | None
    calibrations: tuple[Logistic, Logistic] | None = None
    combined: Logistic | None = None
    history: list[list[int]] = field(default_factory=list)  # for each round: pseudo-labels 0 and 1 that each view got

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.views is None:
            return np.ones(len(a))
        z = [c.logit(v.logit(x)[:, None])[:, None] for v, c, x in zip(self.views, self.calibrations, (a, b), strict=True)]
        return 1 / (1 + np.exp(-self.combined.logit(np.concatenate(z, 1))))


def _columns(df: DataFrame, text_col: str, lang_col: str, source_col: str, chars_col: str) -> list[Column]:
    def maybe(c: str, kind: str) -> Column:
        return F.col(f"`{c}`").cast(kind) if c in df.columns else F.lit(None).cast(kind)

    return [F.col(text_col).cast("string").alias("__text"), maybe(lang_col, "string").alias("__lang"), maybe(source_col, "string").alias("__source"), maybe(chars_col, "long").alias("__chars")]


def _features(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, bounds, data in W.groups(batch.column(0)):
        lang, source, chars = (batch.column(i).slice(lo, hi - lo).to_pylist() for i in (1, 2, 3))
        yield lo, hi, np.concatenate((content(bounds, data), layout(bounds, data)), 1), metadata(lang, source, chars)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, a, b in _features(batch):
            blobs = [pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(4).slice(lo, hi - lo), *blobs], ["id", "a", "b"])


def _added(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """What a function of (labels, aside, both views) adds up to over all rows of a task."""
    f: Callable = pickle.loads(sent.value)
    total = None
    for batch in batches:
        if batch.num_rows:
            views = []
            for i in (2, 3):
                at, raw = W.buffers(batch.column(i))
                views.append(np.frombuffer(raw[at[0] : at[-1]].tobytes(), np.float32).reshape(batch.num_rows, -1).astype(float))
            y = batch.column(0).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            got = f(y, batch.column(1).to_numpy(zero_copy_only=False), *views)
            total = got if total is None else total + got
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "x"])


def add_up(table: DataFrame, f: Callable) -> np.ndarray:
    """The sum of f over all rows of a feature table: a vector of a fixed size."""
    sent = table.sparkSession.sparkContext.broadcast(pickle.dumps(f))
    got = table.mapInArrow(lambda b: _added(b, sent), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    sent.unpersist()
    out = np.zeros(got.num_rows)
    out[np.asarray(got["i"])] = np.asarray(got["x"])
    return out


@dataclass
class Moments:
    """Labels of both kinds, set aside or not, and moments of the views' features over labelled rows."""

    def __call__(self, y, aside, a, b):
        some = ~np.isnan(y)
        counts = [((y == v) & (aside == s)).sum() for s in (False, True) for v in (0, 1)]
        return np.concatenate((counts, *((x[some] ** k).sum(0) for x in (a, b) for k in (1, 2))))


@dataclass
class Sure:
    """Pseudo-labels of all unlabelled rows: those that the one view gives the other."""

    views: tuple[Logistic, Logistic]
    sure: float

    def labels(self, y, a, b):
        """For each view: labels 0 and 1 from the other, -1 for rows that it isn't sure of."""
        edge = np.log(self.sure / (1 - self.sure))
        z = [v.logit(x) for v, x in zip(self.views, (a, b), strict=True)]
        return [np.where(np.isnan(y) & (np.abs(x) >= edge), x > 0, -1).astype(int) for x in (z[1], z[0])]

    def __call__(self, y, aside, a, b):
        return np.array([(x == v).sum() for x in self.labels(y, a, b) for v in (0, 1)], float)


@dataclass
class Steps:
    """Newton sums of both views over labelled rows and weighted pseudo-labels."""

    views: tuple[Logistic, Logistic]
    given: Sure | None
    weights: np.ndarray  # of pseudo-labels: view, label

    def __call__(self, y, aside, a, b):
        own = ~np.isnan(y) & ~aside
        more = self.given.labels(y, a, b) if self.given else [np.full(len(y), -1)] * 2
        out = []
        for view, x, label, weight in zip(self.views, (a, b), more, self.weights, strict=True):
            w = np.where(own, 1.0, np.where(label >= 0, weight[label], 0.0))
            pick = w > 0
            out.append(view.sums(x[pick], np.where(own, y, label)[pick], w[pick]))
        return np.concatenate(out)


@dataclass
class Calibration:
    """Newton sums of each view's calibration, or of the combination, over the rows set aside."""

    views: tuple[Logistic, Logistic]
    calibrations: tuple[Logistic, Logistic]
    combined: Logistic | None
    aside: bool

    def __call__(self, y, aside, a, b):
        pick = ~np.isnan(y) & (aside | (not self.aside))
        z = [v.logit(x[pick])[:, None] for v, x in zip(self.views, (a, b), strict=True)]
        one = np.ones(pick.sum())
        if self.combined is None:
            return np.concatenate([c.sums(x, y[pick], one) for c, x in zip(self.calibrations, z, strict=True)])
        both = np.stack([c.logit(x) for c, x in zip(self.calibrations, z, strict=True)], 1)
        return self.combined.sums(both, y[pick], one)


def co_train(table: DataFrame, plan: Plan, widths: tuple[int, int]) -> Model:
    """table: y (1, 0 or null), aside, and the two views' features (so many) of each row."""
    found = add_up(table, Moments())
    if not len(found):
        return Model(None)
    counts, found = found[:4].reshape(2, 2), found[4:]
    n = counts.sum()
    if n < 20 or (counts.sum(0) == 0).any():
        return Model(None)
    aside = bool((counts > 0).all())  # else there is nothing to set aside
    known = counts[0] if aside else counts.sum(0)
    rows = table if aside else table.withColumn("aside", F.lit(False))
    means = np.split(found / n, np.cumsum([widths[0], widths[0], widths[1]]))
    views = tuple(Logistic.start(m, sq - m * m) for m, sq in (means[:2], means[2:]))
    size = [x.w.size * (x.w.size + 1) for x in views]
    given, weights, history = None, np.zeros((2, 2)), []
    for r in range(plan.rounds + 1):
        if r:
            given = Sure(tuple(Logistic(v.mean, v.scale, v.w) for v in views), plan.sure)
            many = add_up(rows, given).reshape(2, 2)
            history.append(many.astype(int).ravel().tolist())
            weights = np.minimum(1.0, known / np.maximum(many, 1))
        for _ in range(plan.steps):
            sums = np.split(add_up(rows, Steps(views, given, weights)), [size[0]])
            if max([v.step(s, plan.l2) for v, s in zip(views, sums, strict=True)]) < 1e-3:
                break
    calibrations = tuple(Logistic(np.zeros(1), np.full(1, 0.4), np.zeros(2)) for _ in views)
    for _ in range(plan.steps):
        sums = np.split(add_up(rows, Calibration(views, calibrations, None, aside)), 2)
        if max([c.step(s, 0.1) for c, s in zip(calibrations, sums, strict=True)]) < 1e-3:
            break
    combined = Logistic(np.zeros(2), np.full(2, 0.4), np.zeros(3))
    for _ in range(plan.steps):
        if combined.step(add_up(rows, Calibration(views, calibrations, combined, aside)), 0.1) < 1e-3:
            break
    return Model(views, calibrations, combined, history)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", plan: Plan = Plan()) -> Model:
    """The model from all rows of docs and all labels; only features and ids are shuffled."""
    shared_dir(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.min(label_col) > 0).cast("int").alias("y"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(*_columns(docs, text_col, lang_col, source_col, chars_col), F.col(id_col).alias("id"))
    made = rows.mapInArrow(lambda b: W.settled(_rows(b)), f"id {kind}, a binary, b binary")
    # which labelled rows are set aside depends on the row alone
    aside = F.pmod(F.xxhash64("a", "b"), F.lit(4)) == 3
    table = made.join(known, "id", "left").select("y", aside.alias("aside"), "a", "b").checkpoint()
    empty = (np.zeros(2, np.int64), np.zeros(0, np.uint8))
    return co_train(table, plan, (content(*empty).shape[1] + layout(*empty).shape[1], metadata([None], [None], [None]).shape[1]))


def _score(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model: Model = pickle.loads(sent.value)
    for batch in batches:
        for lo, hi, a, b in _features(batch):
            rest = [batch.column(i).slice(lo, hi - lo) for i in range(4, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(model.score(a, b))], [*batch.schema.names[4:], "__score"])


def _scored(docs: DataFrame, model: Model, text_col: str, lang_col: str, source_col: str, chars_col: str, columns: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rows = docs.select(*_columns(docs, text_col, lang_col, source_col, chars_col), *(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(columns)))
    kinds = ", ".join(f"__{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    return rows.mapInArrow(lambda b: W.settled(_score(b, sent)), f"{kinds}, __score double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and kept for each row of docs."""
    out = _scored(docs, model, text_col, lang_col, source_col, chars_col, [id_col])
    return out.select(F.col("__0").alias("doc_id"), F.col("__score").alias("score"), (F.col("__score") >= threshold).alias("kept"))


def keep(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score at least ``threshold``."""
    out = _scored(docs, model, text_col, lang_col, source_col, chars_col, docs.columns)
    return out.where(F.col("__score") >= threshold).select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)))
