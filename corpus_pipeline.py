"""The corpus pipeline: five stages from raw documents to encoded training data.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again before the next. All but the last return the columns of ``documents``;
other columns of docs are left behind, whatever their names.

1. quality rules       bad lines go; documents that fail the rules go
2. quality classifier  documents that the co-trained views reject go
3. near duplicates     of each group (5-word shingles, similarity 0.8) the smallest id stays
4. decontamination     documents with words in a benchmark window go
5. BPE                 the ids of each document's text, and the text they decode to

Defined cases hold for every stage: an empty table gives an empty one with the same
columns; texts of any length are read whole; rows are judged one by one but in stage 3.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import co_training, line_rules, merge_tree, pivot_join, record_files, wu_manber
from gleaner.session import shared_dir, ship, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep, without their bad lines; n_chars is that of what is left.

    Null texts, and those of white space, have no words and go; equal rows share their fate; null ids,
    languages and sources stay as they are.
    """
    ship(spark)
    return line_rules.clean(docs.select(*COLUMNS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.5 or more. Null and empty texts are scored like others, null metadata is a value of its own,
    equal rows share their fate; without labels of both kinds every row stays.
    """
    # fitted on the documents as they came: those the rules rejected are examples too
    model = co_training.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return co_training.keep(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts: that of the smallest id, where null ids are the largest.

    Texts without words (null, empty) link to nothing and stay. Ids may repeat: rows are told apart by id and text,
    and of a group's rows with the smallest id, equal or not, one stays.
    """
    return pivot_join.keep_one(docs.select(*COLUMNS), pivot_join.Law(k=5, num=80, den=100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a word in an occurrence of a benchmark window. Null texts have no words and stay; equal rows share their fate."""
    found = wu_manber.occurrences(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), width=10)
    return found.where("size(spans) = 0").select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of every row; a null text is empty; equal rows and null ids stay."""
    ship(spark)
    return merge_tree.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: A trained classifier and a metric join have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet in the shared folder and read again.

    What a stage has written is deleted when the next one's output is there; the last one's stays, as the
    result reads it.
    """
    out = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{out}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            record_files.remove(spark, before)
        before = path
    return docs
