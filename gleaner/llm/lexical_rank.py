"""Ranked lexical search: the best documents of each query item by integer term scores.

Terms are runs of digits, letters and everything above ASCII, with A-Z in lower case. With N
documents that have a term, L terms in all of them, a document's length n, a term's document
frequency df and its count tf in a document, an item's score of a document is the sum over
its distinct terms of

    w * ((10^9 * tf) div (1000 * tf + 8 * m)),  m = 10 + (90 * n * N) div L,  w = floor(1000 * ln((2N + 2) / (2df + 1)))

in 64-bit integers, but for w's logarithm. Steps:

1. Item terms: (item_id, term), each once. A filter of fixed size over them goes to the tasks.
2. One pass over the documents adds up N, L and the df of the terms that pass; tasks add up first.
3. Postings: rows (shard, bucket, term, doc_id, tf, n) of the terms that pass. The bucket is the
   term's; the shard is the document's, so a term that every document holds is spread over all shards.
   Postings are shuffled once, by shard, as one row a document.
4. They are joined with the weighed item terms by bucket and term. Up to ``BROADCAST`` rows of these go to every
   task: then a shard is joined, scored and summed by item and document where it is, and only the best k of each
   item in each partition are shuffled. Beyond that, both sides are shuffled by shard, bucket and term, and the
   sums by item and document.
5. ``row_number`` over each item's scores gives the best k.

Terms are named by 64-bit hashes. Nothing is left out: the filter passes all item terms, and the
join drops the others that it passes.

Defined cases. A null text has no terms. Rows of one item_id are one item with all their terms, null ids of
items included. Each row of the documents counts and ranks by itself, also where ids or whole rows repeat;
equal scores are ordered by doc_id, nulls last. Items without a matching document have no row. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import words as W
from gleaner.llm.pivot_join import passes, wanted
from gleaner.session import shared_dir

#: Buckets of terms, and rows (item, term, weight) of some 50 bytes that are sent to every task at most.
BUCKETS, BROADCAST = 64, 1 << 20


def _first_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before in any of some columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _counted(words: W.Words, sent=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of each document's distinct terms that pass the filter."""
    term, doc = words.hash, words.doc
    if sent is not None:
        pick = passes(sent.value, term)
        term, doc = term[pick], doc[pick]
    order = np.lexsort((term, doc))
    term, doc = term[order], doc[order]
    at = np.flatnonzero(_first_of_runs(doc, term))
    return doc[at], term[at], np.diff(np.append(at, len(term)))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, bounds, data in W.groups(batch.column(0)):
            doc, term, _ = _counted(W.scan(bounds, data, W.ALNUM, lower=True))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo).take(pa.array(doc)), pa.array(term.view(np.int64))], ["item_id", "term"])


def _totals(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Of a task: (term, df, 0), and (null, documents with a term, terms)."""
    held, df = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    docs = terms = 0
    for batch in batches:
        for _, _, bounds, data in W.groups(batch.column(0)):
            w = W.scan(bounds, data, W.ALNUM, lower=True)
            docs += int(np.count_nonzero(w.counts))
            terms += len(w.hash)
            _, term, _ = _counted(w, sent)
            uniq, number = np.unique(term, return_counts=True)
            held, back = np.unique(np.concatenate((held, uniq)), return_inverse=True)
            df = np.bincount(back, np.concatenate((df, number)), len(held)).astype(np.int64)
            if len(held) > 1 << 20:  # so much at most is held; Spark adds up what is given more than once
                yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(df), pa.array(np.zeros(len(df), np.int64))], ["term", "df", "terms"])
                held, df = held[:0], df[:0]
    term = pa.array([*held.view(np.int64).tolist(), None], pa.int64())
    yield pa.RecordBatch.from_arrays([term, pa.array(np.append(df, docs)), pa.array(np.append(np.zeros(len(df), np.int64), terms))], ["term", "df", "terms"])


def _postings(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """A row for each document: its id, a hash of its terms, their number, its posting lists, and how many equal rows it stands for."""
    for batch in batches:
        for lo, hi, bounds, data in W.groups(batch.column(0)):
            w = W.scan(bounds, data, W.ALNUM, lower=True)
            sums = np.zeros(len(w.hash) + 1, np.uint64)
            np.cumsum(W.mix(w.hash + np.uint64(0x632BE59BD9B4E019)), out=sums[1:])
            name = (sums[w.first[1:]] - sums[w.first[:-1]]).view(np.int64)
            doc, term, tf = _counted(w, sent)
            first = np.searchsorted(doc, np.arange(hi - lo + 1))
            ids = batch.column(1).slice(lo, hi - lo)
            # rows with the same id and terms that meet here go on as one
            same = ids.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((name, same))
            at = np.flatnonzero(_first_of_runs(same[order], name[order]))
            copies = np.diff(np.append(at, len(order)))
            pick = order[at]
            keep = np.diff(first)[pick] > 0
            pick, copies = pick[keep], copies[keep]
            counts = np.diff(first)[pick]
            ends = np.cumsum(counts)
            rows = np.repeat(first[pick] - (ends - counts), counts) + np.arange(counts.sum())
            offsets = pa.array(np.append(0, ends).astype(np.int32))
            columns = [ids.take(pa.array(pick)), pa.array(name[pick]), pa.array(w.counts[pick]), pa.array(copies)]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(term[rows].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(tf[rows].astype(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "name", "n", "copies", "terms", "tfs"])


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = BROADCAST) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest positive scores of each item. most: rows of item terms that may be broadcast."""
    spark = docs.sparkSession
    shared_dir(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    asked = items.select(F.col(item_text).cast("string").alias("text"), F.col(item_col).alias("item_id"))
    asked = asked.mapInArrow(_item_terms, f"item_id {item_kind}, term long").distinct()
    sent = spark.sparkContext.broadcast(wanted(asked.select("term").distinct()))
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id"))

    totals = rows.select("text").mapInArrow(lambda b: _totals(b, sent), "term long, df long, terms long")
    totals = totals.groupBy("term").agg(F.sum("df").alias("df"), F.sum("terms").alias("terms")).checkpoint()
    whole = totals.where("term is null").first()
    n_docs, n_terms = (whole["df"], whole["terms"]) if whole else (0, 0)
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.join(totals.where("term is not null").select("term", "df"), "term").select("item_id", "term", F.expr(f"pmod(term, {BUCKETS})").alias("bucket"), weight.alias("w"))
    weighed = weighed.where("w > 0").checkpoint()

    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.mapInArrow(lambda b: _postings(b, sent), f"doc_id {kind}, name long, n long, copies long, terms array<long>, tfs array<long>")
    packed = packed.withColumn("shard", F.pmod(F.xxhash64("doc_id", "name"), F.lit(shards)).cast("int")).repartition("shard")
    # the same row from several tasks
    packed = packed.groupBy("shard", "doc_id", "name", "n", "terms", "tfs").agg(F.sum("copies").alias("copies"))
    postings = packed.selectExpr("shard", "doc_id", "name", "n", "copies", "inline(arrays_zip(terms, tfs))").selectExpr(
        "shard", f"pmod(terms, {BUCKETS}) as bucket", "terms as term", "doc_id", "name", "copies", "tfs as tf", f"10 + (90 * n * {n_docs}L) div {max(n_terms, 1)}L as m"
    )
    if weighed.limit(most + 1).count() <= most:
        matches = postings.join(F.broadcast(weighed), ["bucket", "term"])
    else:
        every = weighed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        matches = postings.join(every, ["shard", "bucket", "term"])
    score = F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))")
    scores = matches.groupBy("shard", "item_id", "doc_id", "name").agg(F.sum(score).alias("score"), F.max("copies").alias("copies")).where("score > 0")

    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "name")
    top = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
    # a row that stands for equal rows takes as many ranks
    each = top.select("item_id", "doc_id", "name", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))).alias("copy"))
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
