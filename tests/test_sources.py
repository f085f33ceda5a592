from pyspark.sql import functions as F

from gleaner.sources import files


def test_manifest_and_texts(spark, tmp_path):
    (tmp_path / "A b").mkdir()
    (tmp_path / "a").mkdir()
    for name, data in {"A b/x.MP3": b"1", "a/y.flac": b"22", "a/.hidden.mp3": b"", "a/z.txt": b"", "a/j.lrc": "[00:01.00]夢、見る".encode("cp932"), "a/u.lrc": "﻿hi".encode()}.items():
        (tmp_path / name).write_bytes(data)
    got = files.manifest(spark, [str(tmp_path)], (".mp3", ".flac"))
    assert sorted((r.name, r.size) for r in got.collect()) == [("x.MP3", 1), ("y.flac", 2)]
    assert files.manifest(spark, [str(tmp_path), str(tmp_path / "a")], (".flac",)).count() == 2
    assert files.manifest(spark, [str(tmp_path)], (".mp3", ".flac"), "Y.FL").count() == 1
    assert {r.text for r in files.decoded_texts(spark, str(tmp_path)).collect()} == {"[00:01.00]夢、見る", "hi"}
    order = spark.createDataFrame([("a b/x",), ("a/x",)], "p string").orderBy(files.by_components(F.col("p"))).collect()
    assert [r.p for r in order] == ["a/x", "a b/x"]


def test_tags_lists_and_caches(spark, tmp_path):
    tags = spark.createDataFrame([({"TIT2": [" T "], "musicbrainz_id": ["1"], "ISRC": ["x"]},), ({"title": ["b"], "TIT2": [""], "tracknumber": ["3/12"]},), ({},)], "tags map<string, array<string>>")
    got = tags.select(files.tag(F.col("tags"), "title").alias("t"), files.track_number(files.tag(F.col("tags"), "track")).alias("n"), F.map_keys(files.without_tagger_keys(F.col("tags"))).alias("k")).collect()
    assert [(r.t, r.n) for r in got] == [("T", None), ("b", "03"), (None, None)] and got[0].k == ["TIT2"]
    (tmp_path / "list").write_text("# c\nA | B | one\nA | B | two\nno bar\n | x\n")
    assert [tuple(r) for r in files.batch_list(spark, str(tmp_path / "list")).collect()] == [("A | B", "two")]
    (tmp_path / "c.json").write_text('{"a // b": "Album",\n "c // d": ""}')
    assert sorted(tuple(r) for r in files.keyed_cache(spark, str(tmp_path / "c.json")).collect()) == [("a // b", "Album"), ("c // d", "")]
    row = spark.createDataFrame([(bytearray(b"[by:me]\n...."),)], "c binary").select(files.written_by(F.col("c"), "[by:me").alias("x"))
    assert row.first().x is True
    files.report(spark.createDataFrame([(2,), (1,)], "x int"), str(tmp_path / "r"), [F.col("x")])
    assert spark.read.csv(str(tmp_path / "r"), sep="\t", header=True).count() == 2
