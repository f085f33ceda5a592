"""Replays against a loop over the log."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import replay as R

OPS = "seq long, op string, `from` string, `to` string"


def loop(ops, there):
    there, out = set(there), {}
    for seq, op, s, d in sorted(ops):
        if s not in there:
            out[seq] = "source missing"
        elif s == d or (op in ("move", "copy") and d in there):
            out[seq] = "destination taken"
        else:
            out[seq] = ""
            if op != "copy":
                there.discard(s)
            if op != "remove" and d is not None:
                there.add(d)
    return out, there


def check(spark, ops, there):
    df = spark.createDataFrame(ops, OPS).repartition(4)
    listing = spark.createDataFrame([(p,) for p in there], "path string")
    got = R.replay(df, listing)
    want, after = loop(ops, there)
    assert {r.seq: r.why for r in got.collect()} == want
    assert {r.path for r in R.listing_after(got, listing).collect()} == after
    return got


@pytest.mark.parametrize(("n", "paths", "seed"), [(60, 6, 1), (150, 40, 2), (150, 300, 3)])
def test_random_logs_equal_a_loop(spark, n, paths, seed):
    rng = random.Random(seed)
    ops = [(i, rng.choice(["move", "move", "move", "copy", "replace", "remove"]), f"p{rng.randrange(paths)}", f"p{rng.randrange(paths)}") for i in range(n)]
    check(spark, ops, {f"p{i}" for i in range(paths) if rng.random() < 0.5})


def test_a_long_chain_and_a_wanted_path_take_few_rounds(spark, monkeypatch):
    rounds = []
    kind = type(spark.range(1))
    empty = kind.isEmpty
    monkeypatch.setattr(kind, "isEmpty", lambda self: rounds.append(1) or empty(self))
    chain = [(i, "move", f"a{i}", f"a{i + 1}") for i in range(300)]
    check(spark, chain, {"a0"})
    assert len(rounds) <= 12
    rounds.clear()
    check(spark, [(i, "move", f"s{i}", "hot") for i in range(300)] + [(300, "move", "hot", "away"), (301, "move", "s7", "hot")], {f"s{i}" for i in range(5, 300)})
    assert len(rounds) <= 12


def test_odd_operations(spark):
    ops = [(1, "move", "a", "a"), (2, "move", "x", "x"), (3, "remove", "a", None), (4, "move", "b", "a"), (5, "remove", "zz", None), (6, "copy", "a", "c"), (7, "replace", "c", "a"), (8, "move", None, "q")]
    check(spark, ops, {"a", "b"})
    assert R.replay(spark.createDataFrame([], OPS), spark.createDataFrame([("a",)], "path string")).count() == 0


def test_undo_restores_what_was_not_changed_since(spark):
    before = {"A/1", "A/2", "B/3", "B/same", "A/same"}
    log = [(1, "move", "B/3", "A/3"), (2, "dedup", "B/same", "A/same"), (3, "move", "A/1", "A/9")]
    now = {"A/3", "A/same", "A/9", "A/2"}
    df = spark.createDataFrame(log, OPS)

    def undone(there):
        listing = spark.createDataFrame([(p,) for p in there], "path string")
        got = R.undo(df, listing)
        return {r.seq: r.why for r in got.collect()}, {r.path for r in R.listing_after(got.withColumn("seq", -F.col("seq")), listing).collect()}

    assert undone(now) == ({1: "", 2: "", 3: ""}, before)
    why, after = undone(now - {"A/9"} | {"B/3"})  # one file gone since, one place taken since
    assert why == {1: "destination taken", 2: "", 3: "source missing"} and after == {"A/3", "B/3", "A/same", "B/same", "A/2"}


def test_merge_never_overwrites(spark):
    files = [("Ado/Show/01.flac", "a1", False), ("Ado/Show/02.flac", "a2", False), ("Ado/Ado - Show/01.flac", "DIFFERENT", False), ("Ado/Ado - Show/02.flac", "a2", False), ("Ado/Ado - Show/cd/03.flac", "a3", None),
             ("Ado/Ado - Show/._03", "j", True), ("Ado/SHOW/cd/03.flac", "a3", False), ("Ado/SHOW/04.flac", None, False), ("Bob/x.flac", "b", False)]
    groups = [("Ado/Show", "Ado/Show", 0), ("Ado/Ado - Show", "Ado/Show", 1), ("Ado/SHOW", "Ado/Show", 2)]
    got = R.merge_folders(spark.createDataFrame(files, "path string, content string, junk boolean"), spark.createDataFrame(groups, "folder string, keep string, rank int"))
    assert {r["from"]: (r.to, r.status) for r in got.collect()} == {
        "Ado/Ado - Show/01.flac": ("Ado/Show/01.flac", "conflict"), "Ado/Ado - Show/02.flac": ("Ado/Show/02.flac", "same"), "Ado/Ado - Show/cd/03.flac": ("Ado/Show/cd/03.flac", "moved"),
        "Ado/Ado - Show/._03": ("Ado/Show/._03", "deleted"), "Ado/SHOW/cd/03.flac": ("Ado/Show/cd/03.flac", "same"), "Ado/SHOW/04.flac": ("Ado/Show/04.flac", "moved"),
    }
    assert {r.folder: (r.moved, r.same, r.conflicts, r.deleted, r.gone) for r in R.emptied(got).collect()} == {"Ado/Ado - Show": (1, 1, 1, 1, False), "Ado/SHOW": (1, 1, 0, 0, True)}


def test_the_listing_is_read_in_the_scan_of_the_log(spark, monkeypatch):
    seen = []
    scan = R.Scan
    monkeypatch.setattr(R, "Scan", lambda df, *rest: seen.append(df.count()) or scan(df, *rest))
    check(spark, [(-3, "move", "a", "b"), (-2, "copy", "b", "c"), (0, "move", None, "d"), (1, "remove", "c", None)], ["a", "x", "x"])
    assert seen == [7 + 3]  # touched paths and the listing's
