"""Which existing folder, or earlier search result, a wanted one is.

``existing_folder``: names are compared by keys of several tiers (spelled alike, then the same thing written
another way). All tiers go through one equi-join on (parent, tier, key), and one aggregate picks the best: the lowest tier, then most songs, the
shorter name, the alphabet. ``union_by_either``: rows that share one of several keys are one, over any number of steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import stored


def existing_folder(wanted: DataFrame, folders: DataFrame, parent: str, name: str, songs: str, tiers: dict[str, tuple[Column, int]]) -> DataFrame:
    """Distinct (parent, name) of ``wanted`` with ``folder`` (the existing one, else the name itself) and ``tier`` (else ``new``).

    tiers: name -> (key of the column ``name``, least length of a key that counts), the strictest first. Empty and null
    keys match nothing. ``folders`` has (parent, name, songs); a null count is 0.
    """

    def keyed(df: DataFrame, *more: Column) -> DataFrame:
        keys = F.array(*(F.struct(F.lit(i).alias("tier"), key.alias("key"), F.lit(least).alias("least")) for i, (key, least) in enumerate(tiers.values())))
        each = df.select(F.col(parent).alias("parent"), F.col(name).alias("name"), *more, F.explode(keys).alias("k"))
        return each.where("k.key <> '' and char_length(k.key) >= k.least").select("parent", "name", *(c for c in ("songs",) if more), "k.tier", "k.key")

    asked = wanted.select(parent, name).distinct()
    there = keyed(folders, F.coalesce(F.col(songs), F.lit(0)).alias("songs")).withColumnRenamed("name", "folder")
    met = keyed(asked).join(there, ["parent", "tier", "key"])
    best = F.min(F.struct("tier", (-F.col("songs")).alias("few"), F.char_length("folder").alias("wide"), "folder"))
    found = met.groupBy(F.col("parent").alias("__p"), F.col("name").alias("__n")).agg(best.alias("best"))
    joined = asked.join(found, (F.col(parent) == F.col("__p")) & (F.col(name) == F.col("__n")), "left")
    names = F.array(*(F.lit(t) for t in tiers))
    return joined.select(parent, name, F.coalesce("best.folder", name).alias("folder"), F.coalesce(F.get(names, F.col("best.tier")), F.lit("new")).alias("tier"))


def first_by_ending(files: DataFrame, path: str, endings: tuple[str, ...], key: Column | None = None) -> DataFrame:
    """(stem, path): of the files of a stem (case folded) the one whose ending comes first in ``endings``; other endings don't count."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    place = F.array_position(F.array(*(F.lit(e) for e in endings)), ending)
    stem = F.lower(F.regexp_replace(path, r"\.[^./]*$", "")) if key is None else key
    return files.select(stem.alias("stem"), F.col(path).alias("path"), place.alias("place")).where("place > 0").groupBy("stem").agg(F.min(F.struct("place", "path"))["path"].alias("path"))


def union_by_either(parts: list[DataFrame], keys: list[str], rounds: int = 64) -> DataFrame:
    """Rows of all parts, in their order, without those that share a key with an earlier one (directly or over others): group, members and the first row.

    Each part has a column ``pos`` (unique in it); earlier parts come first. Null keys link nothing. Each round gives every row the least
    label that a row with one of its keys has, and follows labels (a label is a row); a long chain takes few rounds.
    """
    rows = reduce(DataFrame.unionByName, (p.withColumn("__at", F.struct(F.lit(i).alias("part"), F.col("pos").cast("long").alias("pos"))) for i, p in enumerate(parts)))
    tags = F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys)), lambda t: t["value"].isNotNull())
    ends = stored(rows.select("__at", F.explode(tags).alias("tag")))
    label = stored(rows.select("__at", F.col("__at").alias("root")))
    for _ in range(rounds):
        low = ends.join(label, "__at").groupBy("tag").agg(F.min("root").alias("root"))
        near = ends.join(low, "tag").groupBy("__at").agg(F.min("root").alias("near"))
        # the least label of a row also holds for the row that was its label before
        hooked = label.join(near, "__at", "left").select("__at", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("old"))
        told = hooked.select(F.col("old").alias("__at"), "root").unionByName(hooked.select("__at", "root")).groupBy("__at").agg(F.min("root").alias("root"))
        jump = told.select(F.col("__at").alias("root"), F.col("root").alias("next"))
        fresh = stored(told.join(jump, "root", "left").select("__at", F.least("root", F.coalesce("next", "root")).alias("root")))
        moved = not fresh.exceptAll(label).isEmpty()
        label = fresh
        if not moved:
            count = label.groupBy("root").agg(F.count(F.lit(1)).alias("members")).withColumnRenamed("root", "__at")
            return rows.join(count, "__at").select(*(c for c in rows.columns if c != "__at"), F.col("__at.part").alias("part"), "members")
    raise RuntimeError("labels did not settle")
