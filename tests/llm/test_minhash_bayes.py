"""MinHash near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest

from gleaner.llm import minhash_bayes as M
from gleaner.llm.pivot_join import Law
from gleaner.llm.queries import QUERIES
from gleaner.session import table
from tests.llm.test_pivot_join import brute, corpus

SCHEMA = "doc_id long, text string, kept int"  # a column that the result has too


def found(spark, rows, plan=M.Plan(), block=M.BLOCK, parts=6):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA).repartition(parts)
    out = M.near(df, plan, block=block).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in out)


@pytest.mark.parametrize(("k", "num"), [(2, 80), (3, 70)])
def test_equals_brute_force(spark, k, num):
    rows = corpus(400, num + k)
    rows.append((990, "w1 w2 " * 60_000))  # a very long text
    assert found(spark, rows, M.Plan(Law(k, num, 100))) == brute(rows, k, num, 100)


def family(n, seed, changes):
    """Copies of one text with some words changed in each, so that many pairs are near the threshold."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for at in r.sample(range(120), r.randint(0, changes)):
            w[at] = f"x{r.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return out


def test_a_dense_family_on_both_sides_of_the_threshold(spark):
    for changes in (8, 14):
        rows = family(250, changes, changes)
        assert found(spark, rows) == brute(rows, 2, 80, 100)


def test_pairs_that_do_not_link_to_the_pivot_are_found_in_blocks(spark, monkeypatch):
    asked = []
    settle = M._settle
    monkeypatch.setattr(M, "_settle", lambda pairs, *rest: asked.append(pairs.count()) or settle(pairs, *rest))
    rows = family(160, 3, 16)
    assert found(spark, rows, block=8) == brute(rows, 2, 80, 100)
    assert len(asked) == 2 and all(asked)  # stars, then pairs of other components


def test_a_large_family_costs_no_pair_of_its_own(spark, monkeypatch):
    asked = []
    settle = M._settle
    monkeypatch.setattr(M, "_settle", lambda pairs, *rest: asked.append(pairs.count()) or settle(pairs, *rest))
    rows = family(1500, 9, 3)
    got = found(spark, rows)
    assert {c for _, _, c in got} == {0} and sum(asked) < 50 * len(rows)


def test_pairs_below_the_threshold_make_no_row_each(spark, monkeypatch):
    asked = []
    settle = M._settle
    monkeypatch.setattr(M, "_settle", lambda pairs, *rest: asked.append(pairs.count()) or settle(pairs, *rest))
    rows = family(600, 5, 17)
    assert found(spark, rows) == brute(rows, 2, 80, 100)
    assert 0 < asked[1] < 20 * len(rows)  # a row for each pair were 17,795


def test_lists_longer_than_a_hand_over(spark, monkeypatch):
    monkeypatch.setattr(M, "LISTED", 50)
    rows = family(200, 4, 16)
    assert found(spark, rows, block=32) == brute(rows, 2, 80, 100)


def test_plan_states_its_probabilities():
    plan = M.Plan()
    assert (1 - 0.8**plan.rows) ** plan.bands <= plan.miss and plan.hashes == plan.rows * plan.bands
    assert plan.risk < 1e-6 and [n for n, _ in plan.batches][-1] == plan.hashes
    # the closed form against the integral of the posterior
    s = np.linspace(0, 1, 200_001)
    for m, n in ((20, 32), (90, 128)):
        density = s**m * (1 - s) ** (n - m)
        assert plan.posterior(m, n) == pytest.approx(density[s >= 0.8].sum() / density.sum(), rel=1e-3)


def test_equal_minima_estimate_the_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for both in (200, 700):
        a, b = pool[:1000], np.concatenate((pool[:both], pool[1000 : 2000 - both]))
        sig = M.signatures(np.concatenate((np.sort(a), np.sort(b))), np.array([0, len(a), len(a) + len(b)]), 2000)
        true = both / (len(a) + len(b) - both)
        assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / 2000) ** 0.5


def test_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(3, text), (5, "other words of five"), (5, text + " tail"), (None, text + " end"), (None, None), (8, ""), (9, " \n"), (10, None), (11, "one"), (12, "ONE"), (13, "one two")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.near(df).collect()), key=str)
    want = [(3, 39, 3, True), (5, 3, 5, True), (5, 40, 3, False), (None, 40, 3, False), (None, 0, None, True), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True)]
    assert got == sorted([*want, (11, 1, 11, True), (12, 1, 11, False), (13, 1, 13, True)], key=str)
    assert M.near(df.limit(0)).count() == 0


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    got = QUERIES["op12_minhash_bayes"](spark, sf).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows, 2, 80, 100)
