"""Sources and sinks: file manifests, decoded texts, tag maps, batch lists, keyed caches, reports.

A manifest has a row for each file: path, name, ext, size, modified. Contents are
read only by the functions that decode them. Media tags come as a table of tag maps
(container dialects differ in keys, not in meaning); services come as catalog tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import unicode as U
from gleaner.sources import snapshots

#: Keys of one meaning in the container dialects, in order of preference. Fixed values.
TAG_KEYS = {
    "title": ("TIT2", "©nam", "title"), "artist": ("TPE1", "©ART", "artist"), "albumartist": ("TPE2", "aART", "albumartist"),
    "album": ("TALB", "©alb", "album"), "track": ("TRCK", "trkn", "tracknumber"), "year": ("TDRC", "©day", "date"), "genre": ("TCON", "©gen", "genre"),
}
#: Keys that taggers leave behind. Fixed values.
TAGGER_PREFIXES = ("musicbrainz_", "acoustid_", "musicip_")
TAGGER_KEYS = ("asin", "barcode", "isrc", "catalognumber", "label", "media", "releasestatus", "releasetype", "releasecountry", "script", "artistsort", "albumartistsort")
MAX_TEXT_BYTES, MAX_TEXT_LINES = 1_000_000, 1500


def manifest(spark: SparkSession, folders: list[str], endings: tuple[str, ...], keyword: str | None = None) -> DataFrame:
    """Files below the folders with one of the endings; hidden names go, the keyword may be anywhere in the path."""
    out = None
    for f in folders:
        part = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
        out = part if out is None else out.unionByName(part)  # overlapping folders count twice, on purpose
    return select_files(out, endings, keyword)


def select_files(files: DataFrame, endings: tuple[str, ...], keyword: str | None = None) -> DataFrame:
    """As ``manifest``, on a table of (path, size, modified)."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    hidden = F.regexp_replace("path", "^[a-z]+:/+", "").rlike(r"(?:^|/)\.[^/]")
    out = files.withColumn("name", name).withColumn("ext", ext).where(F.col("ext").isin(*(e.lower() for e in endings)) & ~F.col("name").startswith(".") & ~F.coalesce(hidden, F.lit(False)))
    return out.where(F.contains(F.lower("path"), F.lit(keyword.lower()))) if keyword else out


def by_components(path: Column) -> Column:
    """Sort key of paths: component by component, so ``a/x`` comes before ``a b/x``."""
    return F.split(path, "/")


def decoded_texts(spark: SparkSession, folder: str, pattern: str = "*.lrc") -> DataFrame:
    """(path, text) of text files in UTF-8, UTF-16 or a legacy encoding; overlong ones go."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    texts = raw.where(F.col("length") <= MAX_TEXT_BYTES).select("path", U.decode_text("content").alias("text"))
    return texts.where(F.size(F.split("text", "\n")) <= MAX_TEXT_LINES)


def written_by(content: Column, marker: str, within: int = 4096) -> Column:
    """Whether a file begins with a text that holds the marker."""
    return F.contains(F.decode(F.substring(content, 1, within), "ISO-8859-1"), F.lit(marker))


def tag(tags: Column, meaning: str) -> Column:
    """First non-empty value of a map<string, array<string>> for a meaning, in any dialect."""
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(F.try_element_at(tags, F.lit(k)), F.lit(1))), F.lit("")) for k in TAG_KEYS[meaning]))


def track_number(value: Column) -> Column:
    """Two digits from a value that begins with up to three."""
    n = F.regexp_extract(value, r"^(\d{1,3})", 1)
    return F.when(n != "", F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n))


def is_tagger_key(key: Column) -> Column:
    low = F.lower(key)
    out = low.isin(*TAGGER_KEYS)
    for p in TAGGER_PREFIXES:
        out = out | low.startswith(p)
    return out


def without_tagger_keys(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, _: ~is_tagger_key(k))


def batch_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, source) of lines "name | source"; # starts a comment, the last line of a name wins."""
    rows = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()).where(~F.col("value").rlike(r"^\s*(?:#|$)"))
    cut = r"^(.*)\|([^|]*)$"  # at the last bar
    parts = rows.where(F.col("value").rlike(cut)).select(F.trim(F.regexp_extract("value", cut, 1)).alias("name"), F.trim(F.regexp_extract("value", cut, 2)).alias("source"), "pos")
    return parts.where("name <> '' and source <> ''").groupBy("name").agg(F.max_by("source", "pos").alias("source"))


def keyed_cache(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """(key, value) of a JSON object; empty values are remembered misses."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))


def report(df: DataFrame, path: str, order: list[Column]) -> None:
    """Tab-separated rows in order (a distributed sort; part files are in order)."""
    df.orderBy(*order).write.mode("overwrite").csv(path, sep="\t", header=True)


def snapshot(ledger: DataFrame, path: str) -> int:
    """The next version of a ledger's table; readers see the old one or the new one (see ``snapshots``)."""
    return snapshots.commit(ledger, path)
