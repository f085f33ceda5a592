"""Toxicity by weak supervision.

1. Terms. From a bounded sample of labelled rows: words of letters (A-Z in lower
   case, whole texts) and word beginnings of 4 to 8 bytes. Terms of toxic
   documents with at least ``min_toxic`` different words before them, which are
   rare in other documents, make the mined lexicon.
2. Voters. Each of many voters says toxic, not toxic or nothing: groups of general
   lexicons of insults in four languages, groups of mined words, groups of mined
   beginnings by length, and patterns (two hits close together, a hit near a word
   of address, doubled marks, no hit in a text of some length).
3. Label model. A generative model of the votes given the hidden label. EM estimates
   the prior and each voter's rates under either label; the voters' dependence given
   that (conditional mutual information) gives the tree of strongest correlations, and
   EM is run again with each voter's rates given the label and its parent's vote, so
   correlations are parameters of the model. The label model never sees labels.
4. Classifier. A linear model (logistic, L2) over terms is trained on the posterior
   labels; it alone scores documents, each in one pass over its text.

Only the sample's votes and term lists go to the driver: ``max_rows`` distinct rows
(of an id and a text), however many ids, copies or documents with one id there are.

Defined cases: null and empty texts get the intercept's score; a sample without a
toxic row leaves the general lexicons; equal rows score alike and count once in the
sample; conflicting labels of an id count as the higher one; a score of just
``threshold`` is predicted 1; an empty table gives none; other columns are ignored,
and labels, lang, source and ids are no inputs.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.words import LOWER_BYTES
from gleaner.session import shared_dir

#: General lexicons of common insults and abuse by language, fixed values; none is taken from any data.
INSULTS = {
    "en": "arrogant awful bastard bigot brat bully clown coward creep cretin crook despicable disgusting dirtbag dumb dunce fool freak "
    "garbage goon halfwit hypocrite idiot ignorant imbecile jerk liar loser lunatic maniac moron nasty nitwit pathetic pig "
    "rat repulsive ridiculous scoundrel scum simpleton sleazy slob snake stupid thug trash twit ugly vermin vile wimp worthless",
    "de": "abschaum arschloch bastard blöd depp dreckig dumm dummkopf ekelhaft feigling gesindel heuchler idiot lügner miststück mistkerl nutzlos "
    "schwachkopf schwein trottel versager widerlich wertlos",
    "fr": "abruti bâtard bouffon connard crétin débile dégoûtant idiot imbécile lâche menteur minable nul ordure pathétique pourriture "
    "raté répugnant salaud stupide",
    "es": "asqueroso basura bastardo cobarde cretino despreciable estúpido fracasado gilipollas idiota imbécil inútil inepto mentiroso miserable "
    "patético payaso repugnante ridículo tonto",
}
#: Words of address in the four languages, fixed values.
ADDRESS = frozenset(w.encode() for w in "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus eres usted ustedes".split())
LEXICON = {w.encode(): language for language, words in INSULTS.items() for w in words.split()}
_WORD = re.compile(rb"[a-z\x80-\xff]+")
LENGTHS = (4, 5, 6, 7, 8)
GROUPS = 5


@dataclass(frozen=True)
class Bounds:
    """At most max_rows distinct labelled rows fit the model."""

    max_rows: int = 30_000
    min_toxic: int = 5
    min_share: float = 0.8


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(LOWER_BYTES))


def terms_of(words: set[bytes]) -> set[bytes]:
    """Words as they are; beginnings with a mark and their length before them."""
    out = set(words)
    for n in LENGTHS:
        out.update(b"^" + w[:n] for w in words if len(w) >= n)
    return out


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bounds: Bounds) -> DataFrame:
    """(row, y, text) of at most max_rows distinct labelled rows that aren't held out, in hash order; checkpointed."""
    shared_dir(docs.sparkSession)
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("y"))
    some = some.orderBy(F.xxhash64("__id"), "__id").limit(bounds.max_rows)
    # at most max_rows pairs are broadcast
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "__id")
    rows = rows.select(F.xxhash64("__id", "text").alias("row"), "y", "text")
    # an id may have any number of rows: the bound is on distinct rows; copies meet before they are shuffled
    cut = rows.groupBy("row").count().orderBy("row").limit(bounds.max_rows).agg(F.max("row")).first()[0]
    return rows.where(F.col("row") <= (cut if cut is not None else 0)).groupBy("row").agg(F.max("y").alias("y"), F.first("text").alias("text")).checkpoint()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (term, word before it) of toxic rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            seen: set[tuple[bytes, int]] = set()
            for y, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                if y > 0:
                    words = words_of(text)
                    for before, w in {*zip([b"", *words], words, strict=False)}:
                        c = zlib.crc32(before)
                        seen.update((t, c) for t in terms_of({w}))
            terms, contexts = zip(*seen, strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array(contexts, pa.int64())], ["term", "context"])


def _rows_with(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other rows each candidate occurs."""
    candidates: set[bytes] = pickle.loads(sent.value)
    for batch in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for y, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            seen[y > 0].update(terms_of(set(words_of(text))) & candidates)
        terms = sorted(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), *(pa.array([seen[y][t] for t in terms], pa.int64()) for y in (1, 0))], ["term", "toxic", "other"])


def mine(rows: DataFrame, bounds: Bounds) -> list[bytes]:
    """Terms of the sample that mark toxic documents, best first.

    Toxic use is counted in distinct contexts (the word before), so the words of a
    toxic text with many copies don't count as often as it was copied. All terms
    with enough contexts are tested for their share of toxic rows; none is left out.
    """
    used = rows.mapInArrow(_contexts, "term binary, context long").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("toxic"))
    found = {bytes(r.term): r.toxic for r in used.where(F.col("toxic") >= bounds.min_toxic).orderBy(F.desc("toxic"), "term").collect()}
    sent = rows.sparkSession.sparkContext.broadcast(pickle.dumps(set(found)))
    counts = rows.mapInArrow(lambda b: _rows_with(b, sent), "term binary, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    good = {bytes(r.term) for r in counts.where(F.col("toxic") >= bounds.min_share * (F.col("toxic") + F.col("other"))).collect()}
    return [t for t in found if t in good]


def _group(term: bytes) -> int:
    return sum(term) % GROUPS


class Voters:
    """Votes (1, 0 or -1) of all voters on one document."""

    def __init__(self, mined: list[bytes]):
        self.index: dict[bytes, int] = {}
        languages = list(INSULTS)
        for t, language in LEXICON.items():
            self.index[t] = 2 * languages.index(language) + _group(t) % 2
        start = 2 * len(languages)
        for t in mined:
            if t[:1] != b"^":
                self.index.setdefault(t, start + _group(t))
            else:
                self.index[t] = start + GROUPS * (1 + LENGTHS.index(len(t) - 1)) + _group(t)
        self.patterns = start + GROUPS * (1 + len(LENGTHS))
        self.n = self.patterns + 6

    def __call__(self, text: str | None, words: list[bytes]) -> np.ndarray:
        out = np.zeros(self.n, np.int8)
        get = self.index.get
        places, addressed = [], []
        for i, w in enumerate(words):
            found = [x for x in (get(w), *(get(b"^" + w[:n]) for n in LENGTHS if len(w) >= n)) if x is not None]
            if found:
                out[found] = 1
                places.append(i)
            if w in ADDRESS:
                addressed.append(i)
        p = self.patterns
        out[p] = any(b - a <= 12 for a, b in zip(places, places[1:], strict=False))
        out[p + 1] = len(places) >= 3
        near = np.array(addressed)
        out[p + 2] = any(np.abs(near - i).min() <= 4 for i in places) if addressed else 0
        out[p + 3] = bool(places) and any(m in (text or "") for m in ("!!", "??", "!?"))
        out[p + 4] = -1 if not places else 0
        out[p + 5] = -1 if not places and len(words) >= 20 else 0
        return out


@dataclass
class LabelModel:
    """What EM has found: posterior of label 1 for each row, and parameters of the voters."""

    posterior: np.ndarray
    accuracies: np.ndarray
    parents: np.ndarray  # the voter that each depends on besides the label, -1: none
    dependence: np.ndarray  # of two voters given the label, 0 to 1


def _dependence(said: list[np.ndarray], post: np.ndarray) -> np.ndarray:
    """Mutual information of all pairs of voters given the label, as a share of what the surer of both has to tell."""
    m = said[0].shape[1]
    out, own = np.zeros((m, m)), np.zeros(m)
    for weight in (1 - post, post):
        total = max(weight.sum(), 1e-9)
        one = [(weight @ s) / total for s in said]
        for a, s in enumerate(said):
            own -= one[a] * np.log(np.maximum(one[a], 1e-12)) * total
            for b, t in enumerate(said):
                both = (s * weight[:, None]).T @ t / total
                out += np.where(both > 1e-12, both * np.log(np.maximum(both, 1e-12) / np.maximum(np.outer(one[a], one[b]), 1e-12)), 0) * total
    out /= np.maximum(np.minimum.outer(own, own), 1e-9)
    np.fill_diagonal(out, 0)
    return np.clip(out, 0, 1)


def _tree(dependence: np.ndarray, least: float) -> np.ndarray:
    """Parents in the forest of greatest dependence (edges below ``least`` are left out)."""
    m = len(dependence)
    parents, best, seen = np.full(m, -1), np.full(m, -1.0), np.zeros(m, bool)
    source = np.full(m, -1)
    for _ in range(m):
        x = int(np.argmax(np.where(seen, -2.0, best)))
        seen[x] = True
        if best[x] >= least:
            parents[x] = source[x]
        closer = ~seen & (dependence[x] > best)
        best[closer], source[closer] = dependence[x][closer], x
    return parents


def label_model(votes: np.ndarray, prior: float = 0.1, rounds: int = 60, least: float = 0.3) -> LabelModel:
    """The label model of a matrix of votes (rows by voters), fitted by EM from the votes alone."""
    n, m = votes.shape
    if n == 0:
        return LabelModel(np.zeros(0), np.zeros(m), np.full(m, -1), np.zeros((m, m)))
    said = [(votes == v).astype(float) for v in (-1, 0, 1)]
    post = np.clip(prior + 0.4 * (votes > 0).sum(1) - 0.4 * (votes < 0).sum(1), 0.02, 0.98)
    parents, dependence = np.full(m, -1), np.zeros((m, m))
    start = post
    for phase in range(2):
        if phase:
            dependence = _dependence(said, post)
            parents = _tree(dependence, least)
            post = start  # what voters without parents agreed on may be copied votes
        # which of the parent's votes each row holds; one state for voters without a parent
        states = [np.where(parents >= 0, s[:, np.maximum(parents, 0)], v == 1) for v, s in enumerate(said)]
        for _ in range(rounds):
            base = np.clip(post.mean(), 0.01, 0.6)
            logit = np.full(n, np.log(base / (1 - base)))
            for state in states:
                # rates of the three votes in this state of the parent, under either label
                rates = []
                for weight in (1 - post, post):
                    seen = state * weight[:, None]
                    got = np.stack([(seen * s).sum(0) for s in said])
                    rates.append((got + 0.5) / (got.sum(0) + 1.5))
                ratio = np.log(rates[1] / rates[0])
                logit += sum((state * s) @ r for s, r in zip(said, ratio, strict=True))
            new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            moved = np.abs(new - post).max()
            post = new
            if moved < 1e-6:
                break
    right = np.where(votes > 0, post[:, None], np.where(votes < 0, 1 - post[:, None], 0)).sum(0)
    return LabelModel(post, right / np.maximum((votes != 0).sum(0), 1), parents, dependence)


def fit_linear(rows: list[list[int]], y: np.ndarray, n: int, l2: float = 2e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on binary sparse rows and soft labels, by accelerated gradient steps."""
    count = np.array([len(r) for r in rows], np.int64)
    doc = np.repeat(np.arange(len(rows)), count)
    col = np.fromiter((x for r in rows for x in r), np.int64, count.sum())
    w, b = np.zeros(n), 0.0
    v, c = w.copy(), b
    rate = 4.0 / max(1.0, float(count.max(initial=0) + 1)) * 2
    many = max(len(rows), 1)
    for k in range(steps):
        z = np.bincount(doc, v[col], len(rows)) + c
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        w2 = v - rate * 8 * (np.bincount(col, g[doc], n) / many + l2 * v)
        b2 = c - rate * 4 * g.mean() if len(rows) else c
        v, c = w2 + k / (k + 3) * (w2 - w), b2 + k / (k + 3) * (b2 - b)
        w, b = w2, b2
    return w, b


@dataclass
class Model:
    """Weights by term, and the intercept."""

    weights: dict[bytes, float]
    intercept: float
    accuracies: list[float]

    def score(self, text: str | None) -> float:
        z = self.intercept
        for t in sorted(terms_of(set(words_of(text))) & self.weights.keys()):
            z += self.weights[t]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _votes(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    voters, index = pickle.loads(sent.value)
    for batch in batches:
        votes, terms = [], []
        for text in batch.column(2).to_pylist():
            words = words_of(text)
            votes.append(voters(text, words).tobytes())
            terms.append(sorted(index[t] for t in terms_of(set(words)) if t in index))
        yield pa.RecordBatch.from_arrays([pa.array(votes, pa.binary()), pa.array(terms, pa.list_(pa.int32()))], ["votes", "terms"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bounds: Bounds = Bounds()) -> Model:
    spark = docs.sparkSession
    rows = sample(docs, labels, id_col, text_col, label_col, bounds)
    terms = list(dict.fromkeys([*LEXICON, *mine(rows, bounds)]))
    voters = Voters(terms)
    index = {t: i for i, t in enumerate(terms)}
    sent = spark.sparkContext.broadcast(pickle.dumps((voters, index)))
    # at most max_rows rows of votes and term numbers
    got = rows.mapInArrow(lambda b: _votes(b, sent), "votes binary, terms array<int>").collect()
    got.sort(key=lambda r: (bytes(r.votes), r.terms))
    votes = np.array([np.frombuffer(r.votes, np.int8) for r in got]).reshape(len(got), voters.n)
    found = label_model(votes)
    if not got:
        return Model({t: 3.0 for t in LEXICON}, -3.0, [])
    w, b = fit_linear([r.terms for r in got], found.posterior, len(terms))
    return Model({t: float(x) for t, x in zip(terms, w, strict=True) if x}, b, found.accuracies.tolist())


def _score(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model: Model = pickle.loads(sent.value)
    for batch in batches:
        scores = [model.score(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rows = docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(lambda b: _score(b, sent), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
