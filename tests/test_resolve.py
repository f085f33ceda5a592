"""Existing folders, unions by either key, nested catalog answers."""

import json
import random

from pyspark.sql import functions as F

from gleaner.functions import unicode as U
from gleaner.operators import catalog, resolve

c = F.col


def test_existing_folder(spark):
    there = [("Ado", "Timely", 3), ("Ado", "TIMELY!!", 9), ("Ado", "Sugar Rush - EP", 1), ("Ado", "OK Computer (Deluxe)", 5), ("Bob", "Ab", 1), ("Ado", "We Don’t Trust You", None)]
    folders = spark.createDataFrame(there, "artist string, name string, songs int")
    want = [("Ado", "timely"), ("Ado", "Timely?"), ("Ado", "SUGAR RUSH"), ("Ado", "OK Computer"), ("Bob", "A-b"), ("Bob", "Timely"), ("Ado", "WE DON'T TRUST YOU"), ("Ado", ""), ("Ado", "timely")]
    tiers = {"exact": (U.nfkc_fold("name"), 1), "identity": (U.album_identity("name", "artist"), 3)}
    got = resolve.existing_folder(spark.createDataFrame(want, "artist string, name string"), folders, "artist", "name", "songs", tiers)
    assert {(r.artist, r.name): (r.folder, r.tier) for r in got.collect()} == {
        ("Ado", "timely"): ("Timely", "exact"), ("Ado", "Timely?"): ("TIMELY!!", "identity"), ("Ado", "SUGAR RUSH"): ("Sugar Rush - EP", "identity"), ("Ado", "OK Computer"): ("OK Computer (Deluxe)", "identity"),
        ("Bob", "A-b"): ("A-b", "new"), ("Bob", "Timely"): ("Timely", "new"), ("Ado", "WE DON'T TRUST YOU"): ("We Don’t Trust You", "identity"), ("Ado", ""): ("", "new"),
    }
    files = spark.createDataFrame([("Ado.png",), ("ado.JPG",), ("Bob.webp",), ("Bob.txt",), ("Eve.txt",)], "path string")
    assert {r.stem: r.path for r in resolve.first_by_ending(files, "path", (".jpg", ".jpeg", ".png", ".webp")).collect()} == {"ado": "ado.JPG", "bob": "Bob.webp"}


def test_union_by_either_key(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, f"i{rng.randrange(60)}"]), rng.choice([None, f"l{rng.randrange(60)}"])) for i in range(80)]
    rows += [(100 + i, f"chain{i}", f"link{(i + 1) // 2 * 2}{i % 2}") for i in range(3)] + [(200 + i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(40)]
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if (a[1] and a[1] == b[1]) or (a[2] and a[2] == b[2]):
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    want = {}
    for r in rows:
        want[find(r[0])] = want.get(find(r[0]), 0) + 1
    schema = "pos int, id string, link string"
    got = resolve.union_by_either([spark.createDataFrame(rows[:50], schema), spark.createDataFrame(rows[50:], schema)], ["id", "link"])
    assert {r.pos: r.members for r in got.collect()} == want


def test_catalog_answers(spark):
    rows = [
        (1, json.dumps({"results": [{"trackName": " "}, {"trackName": "T ", "artistName": "A", "trackTimeMillis": 1500, "releaseDate": "2019-01-02", "trackNumber": 0, "trackId": 7}, {"trackName": "later", "artistName": "x"}]})),
        (2, "{broken"), (3, None), (4, json.dumps({"results": []})), (5, json.dumps({"results": {"a": 1}})), (6, json.dumps([1, 2])),
        (7, json.dumps({"sections": [{"x": 1}, {"metadata": [{"title": "Album", "text": ""}, {"title": "Released", "text": "in May 2021"}]}, {"metadata": [{"title": "Album", "text": " Show "}, {"title": "Released", "text": "1999"}]}]})),
    ]
    df = spark.createDataFrame(rows, "id int, body string")
    assert [tuple(r) for r in catalog.first_track(df, "id", "body").collect()] == [(1, "T", "A", None, 1.5, "2019", None, None, "7", None)]
    assert [tuple(r) for r in catalog.section_fields(df, "id", "body").collect()] == [(7, "Show", "2021")]
    found = {(r.id, r.path): r.value for r in catalog.find_key(df, "id", "body", "text").collect()}
    assert found[7, "$.sections[2].metadata[1].text"] == '"1999"' and len(found) == 4
    assert catalog.find_key(df.limit(0), "id", "body", "x").count() == 0
