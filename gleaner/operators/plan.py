"""Destination planning, collision numbers, operation logs and undo. Effects never run here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.scan import Scan, numbered


def collision_numbers(df: DataFrame, folded: Column, order: list[Column], name: Column, ending: Column, first: int = 2) -> DataFrame:
    """final: the name for the first claim of a folded name, "name (n)" for the next, n from ``first``."""
    df = numbered(df.withColumn("__k", folded), ["__k"], order, "claim")
    text = F.concat(name, F.lit(" ("), (F.col("claim") - 2 + first).cast("string"), F.lit(")"), ending)
    return df.withColumn("final", F.when(F.col("claim") == 1, F.concat(name, ending)).otherwise(text)).drop("__k")


def free_names(df: DataFrame, stem: str, taken: DataFrame, taken_name: str, order: list[Column]) -> DataFrame:
    """As ``collision_numbers`` but past names that exist: the c-th claim of a stem takes its c-th free number.

    ``number`` is 1 for the plain stem. The i-th number in use, h, has h - i free ones below it, so the c-th free
    number is c plus how many h have h - i < c: a prefix count over claims and numbers in use, sorted together.
    """
    base = df.select(F.lower(stem).alias("__s")).distinct()
    ending = F.regexp_extract("__t", r" \((\d{1,9})\)$", 1)
    parsed = taken.select(F.lower(taken_name).alias("__t")).select("__t", ending.alias("__n"), F.regexp_replace("__t", r" \(\d{1,9}\)$", "").alias("__r"))
    plain = parsed.select(F.col("__t").alias("__s"), F.lit(1).cast("long").alias("__n"))
    counted = parsed.where("__n <> ''").select(F.col("__r").alias("__s"), F.col("__n").cast("long").alias("__n")).where("__n >= 2")
    used = numbered(plain.unionByName(counted).distinct().join(base, "__s", "left_semi"), ["__s"], ["__n"], "__i")
    claims = numbered(df.withColumn("__s", F.lower(stem)), ["__s"], order, "__c")
    held = used.select("__s", (F.col("__n") - F.col("__i")).alias("__at"), F.lit(0).alias("__kind"), F.lit(1).cast("long").alias("__one"))
    asked = claims.select("__s", (F.col("__c") - 1).alias("__at"), F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__one"), F.struct(*df.columns).alias("__row"))
    both = Scan(held.withColumn("__row", F.lit(None).cast(asked.schema["__row"].dataType)).unionByName(asked), ["__s"], ["__at", "__kind"])
    found = both.add(__below=("sum", F.col("__one"))).df.where("__kind = 1").select("__row.*", (F.col("__at") + 1 + F.col("__below")).alias("number"))
    n = F.col("number")
    return found.withColumn("final", F.when(n == 1, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit(" ("), n.cast("string"), F.lit(")"))))


def canonical_spelling(df: DataFrame, key: list[str], spelling: str, seq: str) -> DataFrame:
    """Every row gets the spelling that came first for its key."""
    return df.withColumn(spelling, F.min(F.struct(seq, spelling)).over(Window.partitionBy(*key))[spelling])


def destination(root: str, artist: Column, album: Column, track: Column, title: Column, ending: Column) -> Column:
    number = F.when(track.isNotNull() & (track != ""), F.concat(F.lpad(track, 2, "0"), F.lit(" - "))).otherwise("")
    return F.concat_ws("/", F.lit(root.rstrip("/")), artist, F.nullif(album, F.lit("")), F.concat(number, title, ending))


def move_status(moves: DataFrame, existing: DataFrame, dest: str, content: str, path: str, existing_content: str) -> DataFrame:
    """moved, same (equal content is there already) or conflict."""
    there = existing.select(F.col(path).alias(dest), F.col(existing_content).alias("__h"), F.lit(True).alias("__there"))
    return moves.join(there, dest, "left").withColumn("status", F.when(F.col("__there").isNull(), "moved").when(F.col("__h") == F.col(content), "same").otherwise("conflict")).drop("__h", "__there")


def undo(ops: DataFrame, seq: str, source: str, dest: str) -> DataFrame:
    """The log backwards, with ends swapped (a distributed sort)."""
    return ops.orderBy(F.desc(seq)).select(F.col(seq), F.col(dest).alias("from"), F.col(source).alias("to"))


def undo_by(ops: DataFrame, part: list[str], seq: str, source: str, dest: str) -> DataFrame:
    """As ``undo``, each part of the log on its own (parts run side by side)."""
    w = Window.partitionBy(*part).orderBy(F.desc(seq))
    return ops.select(*part, F.row_number().over(w).alias("step"), F.col(seq), F.col(dest).alias("from"), F.col(source).alias("to"))
