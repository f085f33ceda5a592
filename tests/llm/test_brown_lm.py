import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import brown_lm as lm
from gleaner.session import table


def toks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


SIZES = [lm.Size(), lm.Size(contexts=4, classes=2, table=9), lm.Size(contexts=3, classes=2, table=0)]


def corpus():
    r = np.random.default_rng(3)
    v = ["The", "the", "of", "é", "x", "y.", "夢", "zz", "q", "r", "s", "t"]
    docs = [(i, " ".join(r.choice(v, r.integers(0, 30), p=None)) + ("  rare%d\n" % i if i % 5 == 0 else "")) for i in range(80)]
    return docs + [(None, "the null"), (3, None), (900, ""), (901, "of The x " * 20_000), (4, docs[4][1]), (4, docs[4][1])]


def name(word):
    """The hash by which the model knows a word."""
    if word is None:
        return int(lm.END.view(np.int64))
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(lm.W.scan(np.array([0, len(raw)]), raw, lm.W.SPACED, lower=True).hash[0].view(np.int64))


@pytest.mark.parametrize("size", SIZES)
def test_scores_equal_brute_force(spark, size):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, c string").repartition(3)
    fitted = lm.fit(df, size=size)
    got = lm.score(df, fitted).collect()
    taught = [toks(t) for i, t in docs if not out(i)]
    c = Counter(w for t in taught for w in t)
    n, many = sum(c.values()), len(c)

    def base(w):
        return (c[w] + 1) / (n + many + 1)

    # classes as the model has them; counts, transitions and emissions anew from the texts
    m = fitted.model
    of = {int(h): int(m.classes[x]) for h, x in zip(m.table.words.view(np.int64), m.table.number)}
    of |= {r.word: r["class"] for r in fitted.placed.collect()}
    contexts = {int(h) for h, x in zip(m.table.words.view(np.int64), m.table.number) if x < m.contexts}
    assert of.keys() == {name(w) for w in c}
    k = size.classes + 2
    into = np.zeros((k, k))
    for t in taught:
        before = k - 2
        for w in t:
            into[before, of[name(w)]] += 1
            before = of[name(w)] if name(w) in contexts else k - 1
    total = into.sum(0)
    unseen = max(1, sum(x == 1 for x in c.values()))
    into[:, k - 1] = unseen * into.sum(1) / into.sum()
    prior = into.sum(0) + (np.arange(k) == k - 1)
    prior /= prior.sum()
    step = (into + size.strength * prior) / (into.sum(1, keepdims=True) + size.strength)

    def p(w, before):
        cls = of.get(name(w), k - 1)
        return size.mix * step[before, cls] * (c[w] / total[cls] if c[w] else 1) + (1 - size.mix) * base(w)

    def scored(t):
        before, s = k - 2, 0.0
        for w in toks(t):
            s += math.log10(p(w, before))
            before = of[name(w)] if name(w) in contexts else k - 1
        return s

    def row(i, flag, a, b, x, y, z):
        return str(i), flag, a, b, x, round(y, 4), round(z, 4)

    want = sorted(row(i, out(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, sum(math.log10(base(w)) for w in toks(t)), scored(t)) for i, t in docs)
    have = sorted(row(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(have, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6, abs=1e-3)
    # in every context the known words and the unknown type have 1 in all
    for before in range(k):
        assert sum(p(w, before) for w in c) + p("never seen", before) == pytest.approx(1)


def test_partitions_and_the_table_change_nothing(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")

    def scores(rows, size):
        got = lm.score(rows, lm.fit(rows, size=size)).collect()
        return sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 3)) for r in got)

    one = scores(df.coalesce(1), lm.Size(contexts=5, classes=3, table=0))
    assert one == scores(df.repartition(7), lm.Size(contexts=5, classes=3, table=4)) == scores(df, lm.Size(contexts=5, classes=3))


def test_exchange_finds_alternating_classes(spark):
    r = np.random.default_rng(0)
    a, b = [f"a{i}" for i in range(6)], [f"b{i}" for i in range(6)]
    docs = [(i, " ".join(w for _ in range(60) for w in (r.choice(a), r.choice(b)))) for i in range(60)] + [(100 + i, f"a1 rare{i} a2 b0 a0 odd{i}x b1") for i in range(30)]
    size = lm.Size(contexts=13, classes=2)
    fitted = lm.fit(spark.createDataFrame(docs, "doc_id long, text string"), size=size)
    m = fitted.model
    of = {int(h): int(m.classes[x]) for h, x in zip(m.table.words.view(np.int64), m.table.number)}
    assert len({of[name(w)] for w in a}) == 1 == len({of[name(w)] for w in b}) and of[name("a0")] != of[name("b0")]
    assert all(x < y for x, y in zip(fitted.likelihoods, fitted.likelihoods[1:]))
    # rare words are placed by what stands around them
    seen = [i for i in range(30) if not out(100 + i)]
    assert {of[name(f"rare{i}")] for i in seen} == {of[name("b0")]}


def test_better_than_base_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = [r for r in lm.score(docs, lm.fit(docs)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert all(r.score < 0 for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df, lm.fit(df)).count() == 0
