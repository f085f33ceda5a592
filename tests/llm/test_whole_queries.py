"""Registered queries without SQL against brute force over whole small tables."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gleaner.llm.queries import QUERIES
from gleaner.session import table
from tests.llm.test_pivot_join import brute

SF = "/root/testdata/sf0.001"


def texts(spark):
    return sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").collect())


def test_op3(spark):
    got = QUERIES["op3_pivot_join"](spark, SF).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(texts(spark), 3, 90, 100)


def test_op4(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in QUERIES["op4_merge_tree"](spark, SF).collect()}
    for i, t in texts(spark):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_op10(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, at = {r.doc_id: r for r in QUERIES["op10_record_files"](spark, SF).collect()}, 0
    for i, t in texts(spark):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op6_and_op7_score_every_row(spark):
    ids = [i for i, _ in texts(spark)]
    for name in ("op6_weak_toxicity", "op7_co_training"):
        got = QUERIES[name](spark, SF).collect()
        assert sorted(r.doc_id for r in got) == ids and all(0 <= r.score <= 1 for r in got)
