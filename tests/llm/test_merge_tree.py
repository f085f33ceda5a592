import hashlib
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleaner.llm import merge_tree as mt

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_equals_the_library():
    lib, own = Tokenizer.from_file(PATH), mt.Codec(PATH)
    r = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "'s", "é", "夢", "1", "23", "!", "<|endoftext|>", "\t", "　", "ß", "Don't", "́", "😀", "\x1c", "\x85", "|", " x"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(2000)] + ["ab" * 20_000, "x" * 9999, ""]
    for t in texts:
        ids = own.encode(t)
        assert ids == lib.encode(t, add_special_tokens=False).ids, t
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False) == t


LIB, OWN = Tokenizer.from_file(PATH), mt.Codec(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(st.sampled_from("aA 's\n\t\u00a0\u3000.,1é\u0301\x1c\x85"), max_size=40), st.just("<|endoftext|>")), max_size=4))
def test_hostile_texts(texts):
    for t in (" ".join(texts), "".join(texts)):
        assert OWN.encode(t) == LIB.encode(t, add_special_tokens=False).ids


def test_leftmost_of_equal_ranks_first():
    ranks = {(1 << 20) | 1: (0, 2)}
    assert mt.merge([1] * 5, ranks) == [2, 2, 1]
    assert mt.merge([1], ranks) == [1] and mt.merge([], ranks) == []


def test_lockstep_trees_equal_single_ones():
    r = np.random.default_rng(4)
    made = {}
    for rank, (a, b) in enumerate({(int(a), int(b)) for a, b in r.integers(0, 9, (60, 2))} | {(int(a), int(b)) for a, b in r.integers(0, 40, (200, 2))}):
        made[a << 20 | b] = (rank, int(r.integers(0, 40)))
    ranks = mt.Ranks(made)
    for size in (1, 2, 4, 8, 16, 32):
        n = r.integers(1, size + 2, 300)
        rows = np.where(np.arange(size + 1) < n[:, None], r.integers(0, 9, (300, size + 1)), -1).astype(np.int32)
        ids, count = mt.merge_many(rows, ranks)
        parts = np.split(ids, np.cumsum(count)[:-1])
        assert [p.tolist() for p in parts] == [mt.merge(row[:k].tolist(), made) for row, k in zip(rows, n)]


def test_memo_turns_over(monkeypatch):
    monkeypatch.setattr(mt, "MEMO", 20)
    lib, own = Tokenizer.from_file(PATH), mt.Codec(PATH)
    for i in range(40):
        t = " ".join(f"w{j}s and" for j in range(i, i + 15))
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids


def test_rows(spark):
    lib = Tokenizer.from_file(PATH)
    texts = [None, "", "Hello world.", "a  b\n c", "é" * 3000]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(2, "Hello world.", "n")], "doc_id long, text string, n_tokens string")
    for r in mt.digests(df, PATH).collect():
        t = texts[r.doc_id] or ""
        ids = lib.encode(t, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert all(lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids == r.ids and r.decoded == (texts[r.doc_id] or "") for r in mt.encode(df, PATH).collect())
    assert mt.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
