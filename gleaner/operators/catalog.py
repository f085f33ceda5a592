"""Nested catalog answers (JSON of any shape) searched as VARIANT values.

A text that is no JSON, and a path that isn't there, give nulls and no failure. An array's elements keep
their positions, so "the first valid one" is an aggregate over positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import stored


def parsed(df: DataFrame, text: str, name: str = "doc") -> DataFrame:
    return df.withColumn(name, F.try_parse_json(text))


def elements(df: DataFrame, doc: str, path: str, name: str = "item", pos: str = "pos") -> DataFrame:
    """A row for each element of the array (or member of the object) at ``path``; rows without one go."""
    inner = df.withColumn("__v", F.try_variant_get(doc, path, "variant"))
    each = df.sparkSession.tvf.variant_explode(F.col("__v").outer())
    return inner.lateralJoin(each).drop("__v", "key").withColumnsRenamed({"pos": pos, "value": name})


def text_of(doc: str, path: str) -> Column:
    """Trimmed text at a path; null where it is missing, empty or not plain."""
    return F.nullif(F.trim(F.try_variant_get(doc, path, "string")), F.lit(""))


def first_track(answers: DataFrame, key: str, text: str) -> DataFrame:
    """The first result that has a title and an artist: key, title, artist, album, seconds, year, genre, track_number, track_id, cover."""
    each = elements(parsed(answers.select(key, text), text), "doc", "$.results")
    millis = F.try_variant_get("item", "$.trackTimeMillis", "double")
    track = F.struct(
        text_of("item", "$.trackName").alias("title"), text_of("item", "$.artistName").alias("artist"), text_of("item", "$.collectionName").alias("album"),
        F.when(millis != 0, millis / 1000).alias("seconds"), F.nullif(F.substring(text_of("item", "$.releaseDate"), 1, 4), F.lit("")).alias("year"), text_of("item", "$.primaryGenreName").alias("genre"),
        F.nullif(text_of("item", "$.trackNumber"), F.lit("0")).alias("track_number"), F.nullif(text_of("item", "$.trackId"), F.lit("0")).alias("track_id"), text_of("item", "$.artworkUrl100").alias("cover"),
    )
    found = each.select(key, "pos", track.alias("track")).where("track.title is not null and track.artist is not null")
    return found.groupBy(key).agg(F.min_by("track", "pos").alias("track")).select(key, "track.*")


def section_fields(answers: DataFrame, key: str, text: str) -> DataFrame:
    """key, album, year: the first album text and the first released year among the metadata of all sections."""
    sections = elements(parsed(answers.select(key, text), text), "doc", "$.sections", "section", "at")
    each = elements(sections, "section", "$.metadata", "item", "pos").select(key, F.struct("at", "pos").alias("order"), text_of("item", "$.title").alias("title"), text_of("item", "$.text").alias("text"))
    year = F.nullif(F.regexp_extract("text", r"\b(19\d\d|20\d\d)\b", 1), F.lit(""))
    album = F.when((F.col("title") == "Album") & F.col("text").isNotNull(), F.struct("order", "text"))
    released = F.when((F.col("title") == "Released") & year.isNotNull(), F.struct("order", year.alias("text")))
    return each.groupBy(key).agg(F.min(album)["text"].alias("album"), F.min(released)["text"].alias("year"))


def find_key(df: DataFrame, key: str, text: str, wanted: str) -> DataFrame:
    """(key, path, value as JSON) of each member named ``wanted`` at any depth; a round opens one level of all documents."""
    now = stored(parsed(df.select(key, text), text).where("doc is not null").select(key, F.lit("$").alias("path"), F.to_json("doc").alias("json")))
    found = []
    while not now.isEmpty():
        inner = elements_with_keys(now.withColumn("doc", F.try_parse_json("json")), "doc")
        step = F.when(F.col("name").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "name"))
        level = stored(inner.select(key, F.concat("path", step).alias("path"), "name", F.to_json("item").alias("json")))
        found.append(level.where(F.col("name") == wanted).select(key, "path", F.col("json").alias("value")))
        now = level.where(F.col("json").rlike(r"^[\[{]")).select(key, "path", "json")
    out = found[0] if found else now.select(key, "path", F.col("json").alias("value"))
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def elements_with_keys(df: DataFrame, doc: str) -> DataFrame:
    """A row for each member (name) or element (null name) of a document."""
    each = df.sparkSession.tvf.variant_explode(F.col(doc).outer())
    return df.lateralJoin(each).withColumnsRenamed({"key": "name", "value": "item"})
