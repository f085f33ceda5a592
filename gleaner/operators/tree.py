"""Folder trees: ancestors, depth roll-ups, empty, duplicate and odd folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def ancestors(path: Column, most: int | None = None) -> Column:
    """Folders above a path, from the top; at most ``most`` of them."""
    parts = path_parts(path)
    n = F.size(parts) - 1
    n = F.least(n, F.lit(most)) if most else n
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def depth_counts(files: DataFrame, path: str, is_audio: Column, most: int = 2) -> DataFrame:
    """(folder, depth, audio, files): each file counts in all its folders down to a depth."""
    each = files.select(F.explode(ancestors(F.col(path), most)).alias("folder"), is_audio.cast("int").alias("a"))
    return each.groupBy("folder").agg(F.sum("a").alias("audio"), F.count(F.lit(1)).alias("files")).withColumn("depth", F.size(F.split("folder", "/")))


def rollup_counts(df: DataFrame, levels: list[str], **measures: Column) -> DataFrame:
    """One row for each prefix of ``levels``; nulls mark the levels above."""
    return df.rollup(*levels).agg(*(c.alias(n) for n, c in measures.items()))


def empty_folders(folders: DataFrame, folder: str, files: DataFrame, path: str) -> DataFrame:
    """Folders with no file in them or below, deepest first."""
    full = files.select(F.explode(ancestors(F.col(path))).alias(folder)).distinct()
    return folders.join(full, folder, "left_anti").orderBy(F.desc(F.size(F.split(folder, "/"))), folder)


def duplicate_folders(df: DataFrame, parent: str, key: str, name: str, songs: str, plain: str) -> DataFrame:
    """Folders of one parent and key, best first: most songs, plain names, short, alphabetical."""
    w = Window.partitionBy(parent, key)
    ranked = w.orderBy(F.desc(songs), F.desc(plain), F.char_length(name), name)
    out = df.where(F.col(key) != "").withColumn("n", F.count(F.lit(1)).over(w)).where("n > 1")
    return out.withColumn("rank", F.row_number().over(ranked))


def collection_identity(artist: str, key: str, df: DataFrame) -> DataFrame:
    return df.groupBy(artist, key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def sidecars(files: DataFrame, path: str, is_main: Column, endings: tuple[str, ...], common: tuple[str, ...] = ()) -> DataFrame:
    """(main, sidecar): files of the same folder whose name is the main one's stem plus an ending.

    Nothing for a stem that two main files share.
    """
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    mains = files.where(is_main).select(F.col(path).alias("main"), F.lower(stem).alias("stem"))
    mains = mains.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("stem"))).where("n = 1").drop("n")
    low = F.lower(F.col(path))
    cut = F.regexp_replace(low, f"(?:{'|'.join(e.replace('.', chr(92) + '.') for e in sorted(endings, key=len, reverse=True))})$", "")
    others = files.where(~is_main).select(F.col(path).alias("sidecar"), cut.alias("stem"), low.alias("low"))
    others = others.where((F.col("stem") != F.col("low")) & ~F.element_at(F.split("low", "/"), -1).isin(*(common or ("",))))
    return mains.join(others, "stem").select("main", "sidecar")
