"""Containers made here, read back; damage never stops a walk."""

import io
import random
import struct

from pyspark.sql import functions as F

from gleaner.sources import tags as T


def seven(n):
    return bytes((n >> s) & 127 for s in (21, 14, 7, 0))


def frame(name, body, version=4):
    return name + (seven(len(body)) if version == 4 else struct.pack(">I", len(body))) + b"\0\0" + body


def id3(frames, version=4, pad=20):
    body = b"".join(frames) + b"\0" * pad
    return b"ID3" + bytes([version, 0, 0]) + seven(len(body)) + body + b"\xff\xfb" + b"audio" * 50


def flac(comments, picture=True):
    note = struct.pack("<I", 3) + b"lib" + struct.pack("<I", len(comments)) + b"".join(struct.pack("<I", len(c.encode())) + c.encode() for c in comments)
    info = bytes(10) + ((44100 << 44) | 441000).to_bytes(8, "big") + bytes(16)

    def block(kind, raw, last=False):
        return bytes([kind | 128 * last]) + len(raw).to_bytes(3, "big") + raw

    return b"fLaC" + block(0, info) + (block(6, b"p" * 99) if picture else b"") + block(1, bytes(7)) + block(4, note, True) + b"audio" * 50


def atom(name, body):
    return struct.pack(">I", 8 + len(body)) + name + body


def mp4(items):
    data = b"".join(atom(k, atom(b"data", struct.pack(">II", kind, 0) + v)) for k, kind, v in items)
    mvhd = atom(b"mvhd", bytes(12) + struct.pack(">II", 1000, 61_500) + bytes(80))
    return atom(b"ftyp", b"M4A ") + atom(b"mdat", b"x" * 500) + atom(b"moov", mvhd + atom(b"udta", atom(b"meta", bytes(4) + atom(b"ilst", data))))


def walk(raw):
    return T.walk(io.BytesIO(raw), len(raw))


def test_id3_in_all_encodings():
    for version in (3, 4):
        got = walk(id3([frame(b"TIT2", b"\x01" + "夢".encode("utf-16"), version), frame(b"TPE1", b"\x03A\0B", version), frame(b"TALB", b"\x00Caf\xe9\0", version), frame(b"TXXX", b"\x03K\0v", version), frame(b"APIC", b"x" * 300, version)], version))
        assert got["tags"] == {"TIT2": ["夢"], "TPE1": ["A", "B"], "TALB": ["Café"], "TXXX:K": ["v"]} and got["has_art"] and got["error"] is None
    words = frame(b"USLT", b"\x03eng" + b"d\0" + "one\ntwo".encode()) + frame(b"SYLT", b"\x01eng\x02\x01" + "d".encode("utf-16") + b"\0\0" + "la".encode("utf-16") + b"\0\0" + struct.pack(">I", 61_230))
    got = walk(id3([words]))
    assert (got["lyrics"], got["synced"]) == ("one\ntwo", "[01:01.23]la")


def test_flac_and_mp4():
    got = walk(flac(["TITLE=T", "artist=A", "ARTIST=B", "LYRICS=la la", "odd"]))
    assert got["tags"] == {"title": ["T"], "artist": ["A", "B"], "lyrics": ["la la"], "odd": [""]} and got["has_art"] and got["seconds"] == 10.0 and got["lyrics"] == "la la"
    got = walk(mp4([("©nam".encode("latin-1"), 1, "夢".encode()), (b"trkn", 0, b"\0\0\0\x07\0\x0a\0\0"), (b"covr", 13, b"j" * 50), ("©lyr".encode("latin-1"), 1, b"words")]))
    assert got["tags"] == {"©nam": ["夢"], "trkn": ["7"], "©lyr": ["words"]} and got["has_art"] and got["seconds"] == 61.5 and got["lyrics"] == "words" and got["error"] is None


def test_damage_is_told_and_never_raises():
    rng = random.Random(1)
    whole = [id3([frame(b"TIT2", b"\x03title"), frame(b"TPE1", b"\x03a"), frame(b"APIC", b"x" * 50)]), flac(["a=b", "c=d"]), mp4([("©nam".encode("latin-1"), 1, b"n")])]
    for raw in whole:
        for n in range(0, len(raw), 3):
            walk(raw[:n])
        for _ in range(300):
            x = bytearray(raw)
            x[rng.randrange(min(len(x), 220))] = rng.randrange(256)
            walk(bytes(x))
    cut = walk(whole[0][:40])
    assert cut["tags"]["TIT2"] == ["title"] and cut["error"]  # what was read before the damage stays
    assert walk(b"")["error"] and walk(b"RIFFxxxxWAVE")["error"]


def test_source_and_contents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.mp3").write_bytes(id3([frame(b"TIT2", b"\x03one")]))
    (tmp_path / "y.FLAC").write_bytes(flac(["title=two"], picture=False))
    (tmp_path / "z.m4a").write_bytes(b"broken")
    (tmp_path / "no.txt").write_bytes(b"text")
    T.register(spark)
    got = spark.read.format("tags").option("share", 2).load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 2
    rows = {r.path.rsplit("/", 1)[1]: r for r in got.collect()}
    assert set(rows) == {"x.mp3", "y.FLAC", "z.m4a"} and rows["x.mp3"].tags == {"TIT2": ["one"]} and rows["y.FLAC"].has_art is False and rows["z.m4a"].error
    df = spark.createDataFrame([(1, bytearray(id3([frame(b"TIT2", b"\x03one")]))), (2, None), (3, bytearray(b""))], "i int, raw binary")
    assert [(r.i, r.p.kind, r.p.tags) for r in df.select("i", T.parsed(F.col("raw")).alias("p")).orderBy("i").collect()] == [(1, "id3", {"TIT2": ["one"]}), (2, None, None), (3, None, {})]
