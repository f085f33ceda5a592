import pytest
from pyspark.sql import functions as F

from gleaner.functions import unicode as U
from gleaner.operators import policy as p

c = F.col


def test_layers():
    assert p.parse_layers("kanji + Romaji") == ("original", "romanization") and p.parse_layers(["eng", "orig"]) == ("original", "english")
    for wrong in ("", "klingon", []):
        with pytest.raises(ValueError):
            p.parse_layers(wrong)


def test_own_rendering(spark):
    df = spark.createDataFrame([("夢\nyume\n",), ("夢\nyume",), ("yume\ndream\n",), ("else",)], "t string")
    rows = F.array(F.struct(F.lit("夢").alias("text"), F.lit("yume").alias("romaji"), F.lit("dream").alias("english")))
    assert [r.x for r in df.select(p.is_own_rendering(c("t"), rows).alias("x")).collect()] == [True, True, True, False]


def test_policies(spark):
    df = spark.createDataFrame([(False, False, False, True), (True, True, False, True), (True, False, True, True), (True, False, False, True), (False, False, False, False)], "e boolean, o boolean, f boolean, c boolean")
    assert [r.x for r in df.select(p.write_policy(c("e"), c("o"), c("f"), c("c")).alias("x")).collect()] == ["saved", "saved", "backup", "exists", "error"]
    jobs = spark.createDataFrame([(False, None, 1, 0, True), (False, None, 1, 0, False), (True, "en", 1, 0, True), (True, "ja", 1, 1, True), (True, "ja", 2, 1, True)], "f boolean, l string, w int, d int, c boolean")
    assert [r.x for r in jobs.select(p.job_status(c("f"), c("l"), c("w"), c("d"), c("c")).alias("x")).collect()] == ["notfound", "failed", "english", "found", "partial"]


def test_staged_lookup(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    got = p.staged(q, "k", [lambda d: d.where("k = 2"), lambda d: d.where("k <= 2")]).collect()
    assert sorted((r.k, r.stage) for r in got) == [(1, 1), (2, 0)]


def test_original_and_collections(spark):
    df = spark.createDataFrame([("s", False, True, False, 0), ("s", False, False, True, 1), ("s", False, True, True, 2), ("t", False, False, False, 0), ("t", True, False, False, 1)], "k string, e boolean, l boolean, y boolean, pos int")
    assert {r.k: r.pos for r in p.original_priority(df, "k", c("e"), c("l"), c("y"), "pos").collect()} == {"s": 2, "t": 1}
    cand = [("a", "Top 40 Chart", "x", 20, 0), ("a", "Real Album", "x", 12, 1), ("a", "real album", "x", 12, 2), ("a", "x", "x", 1, 3), ("a", "2020", "x", 9, 4), ("b", "Unknown", "y", 9, 0)]
    got = p.collection_vote(spark.createDataFrame(cand, "k string, n string, t string, c int, pos int"), "k", "n", "t", "c", "pos").collect()
    assert [tuple(r) for r in got] == [("a", "Real Album", 2)]
    videos = spark.createDataFrame([("a", "c1", 5, 0), ("a", "c2", 4, 1), ("a", "c2", 4, 2), ("a", "c3", 3, 3)], "k string, ch string, v int, pos int")
    pics = spark.createDataFrame([("c1", "u1"), ("c3", "u3")], "ch string, url string")
    assert [(r.ch, r.url) for r in p.most_viewed_source(videos, "k", "ch", "v", "pos", pics).collect()] == [("c1", "u1")]


def test_romanizer(spark):
    df = spark.createDataFrame([("Привет", "ru"), ("안녕", "ko"), ("hello", "en"), ("", "ja")], "t string, l string")
    out = df.select(p.romanizer(c("l"), c("t"), F.lit(None).cast("string"), U.romanize_hangul("t"), U.romanize_cyrillic("t")).alias("x")).collect()
    assert [r.x for r in out] == ["Privet", "annyeong", "", ""]
