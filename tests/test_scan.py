"""Prefix scans against window functions and plain loops, also where one key holds all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.operators import cluster, plan, scan
from gleaner.operators.scan import CHUNK, Scan

c = F.col
SCHEMA = "k string, i int, v int"


def rows(n, keys, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(keys), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(n)]


@pytest.mark.parametrize("keys", [["a"], ["a"] * 20 + ["b", "c", None], [f"k{i}" for i in range(200)], [None]])
def test_equals_windows(spark, keys):
    df = spark.createDataFrame(rows(600, keys), SCHEMA).repartition(3)
    w = Window.partitionBy("k").orderBy("i")
    up, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.sum("v").over(up).alias("s"), F.sum("v").over(before).alias("sb"), F.max("v").over(up).alias("m"), F.min("v").over(before).alias("n"), F.last("v", True).over(up).alias("l"), F.lag("v").over(w).alias("g"))
    got = Scan(df, ["k"], ["i"], ranges=9).add(s=("sum", c("v")), sb=("sum_before", c("v")), m=("max", c("v")), n=("min_before", c("v")), l=("last", c("v")), g=("lag", c("v"))).df
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_key_that_holds_all_rows_is_spread_over_all_ranges(spark):
    df = spark.range(20_000).select(F.lit("one").alias("k"), c("id").alias("i"))
    s = Scan(df, ["k"], ["i"], ranges=8).add(n=("sum", F.lit(1)))
    sizes = [r["count"] for r in s.rows.groupBy(CHUNK).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    assert s.df.where("n <> i + 1").count() == 0
    # no exchange by the key alone: a range is part of it
    plan_ = s.rows._jdf.queryExecution().executedPlan().toString()
    big = [x for x in plan_.splitlines() if "Exchange hashpartitioning(k" in x]
    assert any(CHUNK in x for x in big)
    clusters = cluster.gap_clusters(df.withColumn("v", c("i").cast("double") + F.floor(c("i") / 5000) * 10), ["k"], "v", 3.0, [])
    assert sorted((r.cluster, r.n) for r in clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()) == [(i, 5000) for i in range(4)]


def test_descending_order_and_no_keys(spark):
    df = spark.createDataFrame(rows(300, ["a", "b"]), SCHEMA)
    got = Scan(df, [], [F.desc("i")], ranges=5).add(s=("sum", F.lit(1)), g=("lag", c("i"))).df.orderBy("i").collect()
    assert [r.s for r in got] == list(range(300, 0, -1)) and [r.g for r in got] == [*range(1, 300), None]
    assert Scan(df.limit(0), ["k"], ["i"]).add(s=("sum", c("v"))).df.count() == 0


def test_first_n(spark):
    df = spark.createDataFrame(rows(100, ["a", "b"]), SCHEMA)
    for n in (-3, 0, 1, 37, 1000):
        assert sorted(r.i for r in scan.first_n(df, ["i"], n).collect()) == list(range(min(max(n, 0), 100)))


def test_stop_after_equals_a_loop(spark):
    rng = random.Random(5)
    data = [(k, i, rng.random() < 0.5) for k in "abcdefgh" for i in range(rng.randint(0, 25))] + [("z", i, None) for i in range(5)]
    got = {(r.k, r.i): (r.streak, r.tried) for r in scan.stop_after(spark.createDataFrame(data, "k string, i int, bad boolean"), ["k"], ["i"], c("bad")).collect()}
    for k in {d[0] for d in data}:
        streak, over = 0, False
        for _, i, bad in sorted(d for d in data if d[0] == k):
            streak = streak + 1 if bad else 0
            assert got[k, i] == (streak, not over)
            over |= streak >= 3


@pytest.mark.parametrize("keys", [["a"], ["a", "b", None]])
def test_size_batches_equal_a_loop(spark, keys):
    rng = random.Random(len(keys))
    data = [(rng.choice(keys), i, rng.choice([None, 0, 0, 1, 3, 7, 10, 11, 40])) for i in range(250)]
    got = {r.i: r.batch for r in scan.size_batches(spark.createDataFrame(data, SCHEMA), ["k"], ["i"], "v", 10).collect()}
    for k in set(keys):
        batch, used = -1, 0
        for key, i, size in data:
            if key != k:
                continue
            if batch < 0 or used + (size or 0) > 10:
                batch, used = batch + 1, 0
            used += size or 0
            assert got[i] == batch


def test_free_names_equal_a_loop(spark):
    rng = random.Random(8)
    stems = ["x", "X", "y", "z (2)"]
    taken = [(f"{rng.choice(stems)} ({rng.randint(0, 40)})",) for _ in range(60)] + [("y",), ("Y",), ("x (2) (3)",)]
    want = [(i, rng.choice(stems)) for i in range(120)]
    got = plan.free_names(spark.createDataFrame(want, "id int, stem string"), "stem", spark.createDataFrame(taken, "n string"), "n", [c("id")])
    names, expect = {t.lower() for (t,) in taken}, {}
    claimed = {}
    for i, stem in want:
        own = claimed.setdefault(stem.lower(), set())
        n = 1
        while n in own or (f"{stem} ({n})".lower() if n > 1 else stem.lower()) in names:
            n += 1
        own.add(n)
        expect[i] = stem if n == 1 else f"{stem} ({n})"
    assert {r.id: r.final for r in got.collect()} == expect


def test_size_batches_take_no_rounds(spark, monkeypatch):
    rng = random.Random(8)
    data = [("a" if i < 2900 else "b", i, rng.choice([0, 1, 3, 7, 10, 11])) for i in range(3000)]
    df, calls = spark.createDataFrame(data, SCHEMA), []
    cls = type(df)
    cut = cls.checkpoint
    monkeypatch.setattr(cls, "checkpoint", lambda self, *a, **k: calls.append(1) or cut(self, *a, **k))
    got = {r.i: r.batch for r in scan.size_batches(df, ["k"], ["i"], "v", 10).collect()}
    assert len(calls) == 2  # ranges, and what goes from one to the next
    last, batch, used = None, 0, 0
    for k, i, v in data:
        if k != last:
            last, batch, used = k, 0, v
        elif used + v > 10:
            batch, used = batch + 1, v
        else:
            used += v
        assert got[i] == batch
