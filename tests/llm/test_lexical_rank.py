"""Ranked search against a plain version in Python."""

import math
import random
import re
from collections import Counter

import pytest

from gleaner.llm import lexical_rank as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [x.translate(LOWER) for x in TERM.findall(text or "")]


def plain(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    some = [b for _, b in bags if b]
    n_docs, n_terms = len(some), sum(sum(b.values()) for b in some)
    df = Counter(x for b in some for x in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, want in asked.items():
        found = []
        for doc, bag in bags:
            score = 0
            for x in want & bag.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                m = 10 + 90 * sum(bag.values()) * n_docs // n_terms
                score += w * (10**9 * bag[x] // (1000 * bag[x] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_plain_version(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.4)) % 300}" for _ in range(400)] + ["Ärger", "日本", "X_Y", "the", "The", "THE"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(300)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (900, docs[7][1]), (7, "the other text"), (None, docs[9][1]), (None, docs[9][1]), (None, None), (901, None), (902, ""), (903, "the " * 30_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=8))) for i in range(25)] + [(3, "the w1"), (50, None), (51, "nosuchterm"), (None, "THE w2"), (52, docs[7][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert result(R.search(d, q)) == plain(docs, items, 10)
    assert result(R.search(d, q, k=3)) == plain(docs, items, 3)


def test_a_term_that_all_documents_hold_and_many_copies(spark):
    docs = [(i, "common words here") for i in range(500)] + [(1000 + i, f"common item{i}") for i in range(50)]
    items = [(i, f"common item{i}") for i in range(50)] + [(99, "words")]
    got = result(R.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string")))
    assert got == plain(docs, items, 10)
    assert [d for i, _, d, _ in sorted(got) if i == 99] == list(range(10))  # ties by ascending id


def test_the_same_row_in_several_tasks(spark):
    docs = [(5, "a b"), (6, "a c"), (None, "a d")] * 40 + [(8, "b")]
    items = [(1, "a"), (2, "a b"), (3, "d")]
    assert result(R.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(9), spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items, 10)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3, 4)], "doc_id long, text string, term int, score int")
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a", 5)], "item_id long, text string, doc_id int")
    assert result(R.search(docs, items)) == plain([(1, "a b")], [(1, "a")], 10)
    assert R.search(none, items).count() == 0 and R.search(docs, items.limit(0)).count() == 0


def test_postings_are_shuffled_once_and_scores_not_at_all(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(50)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = R.search(docs, items)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line.split("Exchange hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert sorted(x.split("#")[0] for x in shuffles) == ["item_id", "shard"] and "WindowGroupLimit" in plan


def test_too_many_item_terms_for_a_broadcast(spark):
    docs = [(i % 40, f"a b c{i % 7} d{i % 5}") for i in range(90)]
    items = [(i, f"a c{i} d{i}") for i in range(9)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(R.search(d, q, most=3)) == result(R.search(d, q)) == plain(docs, items, 10)
