"""Incremental ledgers: what is settled, what is pending, and how a run updates it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(ledger: DataFrame, now: Column, ttl_days: float, expiring: tuple[str, ...], status: str = "status", at: str = "at") -> DataFrame:
    """Entries that still hold: statuses in ``expiring`` hold for ``ttl_days``."""
    age = now.cast("timestamp").cast("double") - F.col(at).cast("timestamp").cast("double")
    return ledger.where(~F.col(status).isin(*expiring) | (age <= ttl_days * 86400))


def pending(items: DataFrame, holds: DataFrame, key: str) -> DataFrame:
    """Items with no entry that holds: an anti-join."""
    return items.join(holds.select(key).distinct(), key, "left_anti")


def upsert(ledger: DataFrame, news: DataFrame, key: str, at: str = "at", certain: str | None = None) -> DataFrame:
    """Newest entry of each key; with ``certain``, only certain news are remembered."""
    if certain:
        news = news.where(F.col(certain)).drop(certain)
    both = ledger.withColumn("__s", F.lit(0)).unionByName(news.withColumn("__s", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc("__s"))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__s")


def rekey(ledger: DataFrame, moves: DataFrame, key: str, old: str = "old", new: str = "new") -> DataFrame:
    """Entries follow moved keys, unless the new key has an entry of its own."""
    own = ledger.select(F.col(key).alias(new)).distinct().withColumn("__own", F.lit(True))
    free = moves.join(own, new, "left").where("__own is null").select(F.col(old).alias(key), F.col(new).alias("__new"))
    return ledger.join(free, key, "left").withColumn(key, F.coalesce("__new", key)).drop("__new")


def with_all_outputs(items: DataFrame, key: str, outputs: DataFrame, kind: str, wanted: tuple[str, ...]) -> DataFrame:
    """Items that have an output of every wanted kind (relational division by one aggregate)."""
    full = outputs.where(F.col(kind).isin(*wanted)).groupBy(key).agg(F.count_distinct(kind).alias("__n")).where(F.col("__n") == len(set(wanted)))
    return items.join(full, key, "left_semi") if wanted else items


def statuses(items: DataFrame, ledger: DataFrame, key: str, now: Column, ttl_days: float, expiring: tuple[str, ...], saved: Column, status: str = "status", at: str = "at") -> DataFrame:
    """items with state: pending, else the ledger's status, else saved; expired entries are pending."""
    holds = settled(ledger, now, ttl_days, expiring, status, at).select(key, F.col(status).alias("__st"))
    return items.join(holds, key, "left").withColumn("state", F.coalesce("__st", F.when(saved, "saved"), F.lit("pending"))).drop("__st")
