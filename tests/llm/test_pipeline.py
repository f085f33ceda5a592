import corpus_pipeline as cp

from gleaner.llm import co_training, line_rules, merge_tree
from gleaner.session import shared_dir, table
from tests.llm.test_pivot_join import brute as components
from tests.llm.test_wu_manber import brute as contamination

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    shared_dir(spark)
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    docs = table(spark, SF, "documents")
    rules = cp.quality_rules(spark, docs, SF)
    kept = {r.doc_id for r in line_rules.judge(docs).where("kept").collect()}
    assert rules.columns == docs.columns and {r.doc_id for r in rules.collect()} == kept
    good = cp.quality_classifier(spark, rules, SF)
    model = co_training.fit(docs, table(spark, SF, "labels"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in co_training.score(rules, model).where("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    single = cp.near_duplicates(spark, good, SF)
    left = {d for d, _, c in components(rows, 5, 80, 100) if d == c}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == left
    clean = cp.decontamination(spark, single, SF)
    assert {r.doc_id for r in clean.collect()} == {d for d, t in rows if d in left and not contamination(t, bench)[4]}
    encoded = {r.doc_id: r for r in cp.bpe(spark, clean, SF).collect()}
    assert all(encoded[r.doc_id].decoded == r.text for r in clean.collect()) and len(encoded) == clean.count()
    assert merge_tree.codec(cp.public_tokenizers.path("byte_bpe_50k.json"))


def test_run_gives_what_the_stages_give(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"] and got.count() > 20


def test_stages_take_empty_and_null_rows(spark):
    shared_dir(spark)
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "x", 0), (None, "a\nb", None, "x", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            assert stage(spark, rows, SF).count() <= 3
