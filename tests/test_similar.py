"""Matching blocks against the standard library's, bounds against the ratio."""

import random
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import similar as S


def library(a, b):
    return SequenceMatcher(None, a, b).ratio()


@settings(max_examples=300, deadline=None)
@given(st.text("ab1 é夢", max_size=30), st.text("ab1 é夢", max_size=30))
def test_equals_the_library(a, b):
    assert S.ratio(a, b) == library(a, b)


def test_equals_the_library_on_long_texts():
    rng = random.Random(3)
    for n in (150, 199, 200, 201, 320):
        for letters in ("abc", "abcdefghijklmnopqrstuvwxyz0123456789", "ab" + "".join(map(chr, range(200, 500)))):
            a = "".join(rng.choices(letters, k=n))
            b = list(a)
            for _ in range(n // 5):
                b[rng.randrange(n)] = rng.choice(letters)
            b = "".join(b[rng.randrange(9) :]) + "".join(rng.choices(letters, k=rng.randrange(40)))
            assert S.ratio(a, b) == library(a, b)
            assert S.ratio(b, a) == library(b, a)


def test_bounds_and_verdicts(spark):
    rng = random.Random(7)
    rows = [("".join(rng.choices("abc0", k=rng.randrange(9))), "".join(rng.choices("abc0é", k=rng.randrange(9)))) for _ in range(300)] + [(None, "a"), ("", ""), ("a", None)]
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.length_bound(a, b).alias("n"), S.count_bound(a, b).alias("c"))
    got = S.with_ratio_above(df, "a", "b", 0.6, "r").collect()
    for r in got:
        if r.a is None or r.b is None:
            assert r.r is None
            continue
        true = library(r.a, r.b)
        assert r.r == (true > 0.6) and r.n >= true - 1e-12 and r.c >= true - 1e-12
    assert sum(r.c <= 0.6 for r in got if r.c is not None) > 50  # decided without a comparison


def test_words(spark):
    rows = [(["nova", "cane"], ["novo", "x"]), (["same"], ["same"]), ([], ["a"]), (["abc"], ["xyz"]), (None, ["a"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [r[0] for r in S.with_words_alike(df.withColumn("all", F.lit(True)), "a", "b", 0.75, "all", "r").select("r").collect()] == [True, True, False, False, False]


def test_each_pair_of_names_is_compared_once(spark, tmp_path):
    from gleaner.plans.registry import QUERIES

    names = [("large ring", "LARGE"), ("hot bolt", "ECONOMY"), (None, "SMALL"), ("hot bolt", None)]
    spark.createDataFrame([(i, *names[i % 4]) for i in range(200)], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["seq_ratio_mismatch"](spark, str(tmp_path))
    got = {r.p_partkey: r.severe for r in df.collect()}
    assert got == {i: i % 4 == 1 for i in range(200)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.rindex("Aggregate") > plan.rindex("PythonUDF" if "PythonUDF" in plan else "EvalPython")
