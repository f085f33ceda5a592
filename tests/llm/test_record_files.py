import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import record_files as rf

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello, World's\n\n2 cats", "é ́b \x1c \x85 ΑΣ ΑΣ. İ ß 夢中 <|endoftext|>x <|startoftext|>", "a" * 5000, "don't 'S 're " * 300, "x\ty\rz　w", "a b"]


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_files_hold_the_library_ids_in_order(spark, tmp_path):
    rows = [(100 - i, t, "x") for i, t in enumerate(TEXTS)] + [(7, "same", None), (7, "same", None), (None, "null id", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    manifest = rf.write(df, f"file://{tmp_path}/out", PATH, 2, parts=3)
    got = sorted(rf.read(manifest).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in want]
    at = 0
    for r, (_, text, _) in zip(got, want, strict=True):
        ids = library(text) + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    file = rf.Reader(manifest.orderBy("part").first().path)
    for i in reversed(range(len(file))):
        assert file.read(i)[0] == want[i][0] and file.read(i)[1].tolist() == library(want[i][1]) + [2]


def test_damage_is_found(tmp_path):
    w = rf.Writer(f"file://{tmp_path}/p", 2)
    w.add(1, b"\1\0\2\0")
    w.add(-5, b"")
    w.close()
    assert [(i, b, x.tolist()) for i, b, x in rf.Reader(f"{tmp_path}/p").scan()] == [(1, 0, [1, 2]), (-5, 2, [])]
    data = bytearray((tmp_path / "p.rec").read_bytes())
    data[30] ^= 1
    (tmp_path / "p.rec").write_bytes(data)
    with pytest.raises(ValueError):
        list(rf.Reader(f"{tmp_path}/p").scan())


def test_memo_turns_over(monkeypatch):
    monkeypatch.setattr(rf, "MEMO", 50)
    enc = rf.Encoder(PATH)
    for i in range(30):
        text = " ".join(f"w{j} Common" for j in range(i, i + 20))
        assert np.frombuffer(enc.encode(pa.array([text]))[0], "<u2").tolist() == library(text)


def test_any_vocabulary_file_gives_the_library_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = rf.Encoder(path)
    texts = [t for t in TEXTS if t] + ["two  spaces <|endoftext|> end"]
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u2").tolist() for b in enc.encode(pa.array(texts))] == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(st.sampled_from("aA.,'sS <|>\n\t éÉ\u0301İΣ1²\x1c\x85\u3000"), max_size=30), st.sampled_from(["\u0958\u0958", "a\u0130.", "\u0958.", "\ufb2c", "\u1e9e\u01c5", "<|EndOfText|>", "<|endoftext|>.", "it's.", "ABC,", "a.b."])), max_size=4))
def test_hostile_texts(texts):
    enc = rf.encoder(PATH)
    lib = enc.lib
    for text in (" ".join(texts), "\n".join(texts), "".join(texts)):
        got = np.frombuffer(enc.encode(pa.array([text, None]))[0], "<u2").tolist()
        assert got == lib.encode(text, add_special_tokens=False).ids


def test_equal_ids_come_in_the_order_of_their_texts_hashes(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    df = spark.createDataFrame([(4, t) for t in ("b b", "a", "c c c", "a")], "doc_id long, text string")
    order = [r.text for r in df.withColumn("h", F.xxhash64("text")).orderBy("h").collect()]
    got = sorted(rf.read(rf.write(df, f"file://{tmp_path}/out", PATH, 2, parts=2)).collect(), key=lambda r: r.start)
    assert [r.n_tokens for r in got] == [len(library(t)) + 1 for t in order]


def test_empty(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rf.read(rf.write(df, f"file://{tmp_path}/out", PATH, 2)).count() == 0
