import math
import re
import zlib

import numpy as np

from gleaner.llm import weak_toxicity as wt
from gleaner.session import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in wt.score(docs, wt.fit(docs, labels)).collect()}
    assert len(got) == docs.count()
    y = {r.doc_id: r.toxic for r in labels.collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    own = [(got[i].predicted, t) for i, t in y.items() if got[i].held_out]
    tp = sum(p and t for p, t in own)
    assert tp / max(1, sum(t for _, t in own)) > 0.85
    assert tp / max(1, sum(p for p, _ in own)) > 0.85


def test_label_model_finds_good_voters():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.2
    good = [np.where(r.random(4000) < 0.9, y, ~y) * 2 - 1 for _ in range(4)]
    votes = np.stack([*good, good[0], r.integers(-1, 2, 4000)], 1).astype(np.int8)
    found = wt.label_model(votes)
    assert ((found.posterior > 0.5) == y).mean() > 0.95
    assert found.accuracies[:4].min() > 0.8 > 0.7 > found.accuracies[5]
    # the copied voter depends on its original, and on nothing else but the label
    assert found.parents[4] == 0 or found.parents[0] == 4
    assert found.dependence[0, 4] > 0.9 > found.dependence[1, 2] + 0.3


def test_copied_votes_count_once():
    r = np.random.default_rng(1)
    y = r.random(6000) < 0.3
    say = [np.where(r.random(6000) < q, y, ~y) * 2 - 1 for q in (0.75, 0.85, 0.85, 0.8)]
    votes = np.stack([say[0]] * 2 + say[1:], 1).astype(np.int8)
    found, naive = wt.label_model(votes), wt.label_model(votes, least=99.0)
    assert {found.parents[0], found.parents[1]} & {0, 1}
    assert ((found.posterior > 0.5) == y).mean() > max(0.87, ((naive.posterior > 0.5) == y).mean() + 0.05)


def test_scores_equal_brute_force(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = wt.fit(docs, labels)
    texts = [*docs.collect(), *spark.createDataFrame([(-1, "Idiot! " * 50_000 + "x" * 300_000), (-2, "Crétin ÉÉ idiotisch")], "doc_id long, text string").collect()]
    got = {r.doc_id: r.score for r in wt.score(docs.select("doc_id", "text").unionByName(spark.createDataFrame([(r.doc_id, r.text) for r in texts[-2:]], "doc_id long, text string")), model).collect()}
    for r in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "").encode()
        words = set(re.findall(rb"[a-z\x80-\xff]+", low))
        own = words | {b"^" + w[:n] for w in words for n in range(4, 9) if len(w) >= n}
        z = model.intercept + sum(model.weights.get(t, 0) for t in own)
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 1e-9


def test_the_sample_is_bounded_by_rows(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(3, "copy")] * 300, "doc_id long, text string")
    rows = wt.sample(docs, labels, "doc_id", "text", "toxic", wt.Bounds(max_rows=40)).collect()
    assert len(rows) == 40 == len({r.text for r in rows})
    assert len(wt.sample(docs, labels, "doc_id", "text", "toxic", wt.Bounds()).collect()) == 301


def test_the_threshold_itself_is_predicted(spark):
    docs = spark.createDataFrame([(3, "you idiot"), (3, "you idiot"), (5, "fine")], "doc_id long, text string")
    model = wt.Model({b"idiot": 1.0}, -1.5, [])
    edge = model.score("you idiot")
    assert sorted(r.predicted for r in wt.score(docs, model, threshold=edge).collect()) == [0, 1, 1]


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "you idiot", "x"), (None, "fine", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r for r in wt.score(docs, wt.fit(docs, none)).collect()}
    assert got[1].score == got[2].score < 0.3 and got[3].predicted == 1 and got[None].held_out is False
    assert wt.score(docs.limit(0), wt.fit(docs.limit(0), none)).count() == 0
