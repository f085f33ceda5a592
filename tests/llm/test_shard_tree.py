import zlib

from gleaner.llm import shard_tree as st

SCHEMA = "doc_id long, text string, shard string"


def rows(spark, data):
    return st.place(spark.createDataFrame(data, SCHEMA), buckets=4).collect()


def test_law_slots_and_nulls(spark):
    data = [(i, None if i % 7 == 0 else "é" * (i % 50), "clash") for i in range(400)] + [(5, "same", None)] * 300 + [(None, "x", "y")]
    got = rows(spark, data)
    assert len(got) == len(data)
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted(
        (False, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in data if i is not None
    )
    slots = {}
    for r in got:
        assert 0 <= r.shard < 8 and r.law == "key" and r.grown_shard in (r.shard, 8)
        assert r.rack == r.shard // 2 and r.region == r.shard // 4
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    assert any(r.grown_shard == 8 for r in got)


def test_weight_moves_only_in_the_changed_subtree(spark):
    tree = st.even_tree(8)
    heavier = (*tree[:7], st.Shard(1, 3, 7, 3.0))
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    from pyspark.sql import functions as F

    key = st.key_of(F.col("doc_id"))
    got = st.descend(st.descend(ids, key, tree), key, heavier, "new_").collect()
    for r in got:
        if r.region != r.new_region:
            assert r.new_region == 1
        elif r.rack != r.new_rack:
            assert r.new_rack == 3
        elif r.shard != r.new_shard:
            assert r.new_shard == 7
    share = sum(r.new_shard == 7 for r in got) / len(got)
    assert 0.25 < share < 0.35


def test_empty(spark):
    assert rows(spark, []) == []


def test_a_hot_row_is_spread_in_runs(spark, monkeypatch):
    monkeypatch.setattr(st, "RUN", 7)
    df = spark.createDataFrame([(1, "hot")] * 100 + [(2, "x" * 500_000), (3, None), (3, None)], "doc_id long, text string")
    placed = st.place(df)
    got = placed.collect()
    assert len(got) == 103
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert {r["size"] for r in got if r.doc_id == 2} == {500_001}
