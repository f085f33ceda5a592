"""Write policies, staged lookups and collection votes: rules that combine other operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import scalars as S
from gleaner.operators import classify, layers, match

LAYERS = ("original", "romanization", "english")
FIELDS = {"original": "text", "romanization": "romaji", "english": "english"}
#: Other names of layers. Fixed values.
LAYER_NAMES = {
    "original": ("original", "orig", "text", "native", "source", "kanji", "hangul", "hanzi", "cyrillic", "script"),
    "romanization": ("romanization", "romanisation", "roman", "romaji", "pinyin", "rom"),
    "english": ("english", "translation", "translated", "en", "eng"),
}
#: Names of collections that say nothing about a song: sites, counters, charts, samplers. Fixed patterns.
JUNK_COLLECTION = (
    r"(?iu)(?:https?://|www\.|\.(?:com|net|org|cn|ru|cc|to|xyz|me|io|top|site|tv|link|app)\b)"
    r"|(?:[【\[].*?(?:下载|无损|资源|xmwsyy|repack|flac|mp3).*?[】\]])"
    r"|(?:下载|无损音乐|視聴|views?\b|vistas?\b|visualizaciones\b|subscribe|bilibili|youtube|sound-?cloud|free download|album rip)"
    r"|(?:\b(?:billboard|hottest \d+|top \d+|chart|charts|shazam|various artists|compilation|greatest hits|now that's what i call|playlist|dj mix|best of|tik\s?tok)\b)"
    r"|(?:精选|精選|大全|神曲|ヒット|ランキング)"
)


def parse_layers(value: str | Iterable[str]) -> tuple[str, ...]:
    """Layer names in display order; raises ValueError for an unknown name or none."""
    given = [x.strip().lower() for x in (re.split(r"[,+/\s]+", value) if isinstance(value, str) else value)]
    known = {alias: layer for layer, aliases in LAYER_NAMES.items() for alias in aliases}
    if wrong := [x for x in given if x and x not in known]:
        raise ValueError(f"unknown layer {wrong[0]!r}: use one of {', '.join(LAYERS)}")
    chosen = {known[x] for x in given if x}
    if not chosen:
        raise ValueError(f"pick at least one of {', '.join(LAYERS)}")
    return tuple(x for x in LAYERS if x in chosen)


def is_own_rendering(text: Column, rows: Column) -> Column:
    """Whether a text is what some choice of layers renders, with or without its last line feed."""
    fields = [tuple(FIELDS[x] for x in choice) for n in (1, 2, 3) for choice in combinations(LAYERS, n)]
    options = F.array(*(layers.render_plain(rows, f) for f in fields))
    return F.exists(options, lambda o: (o == text) | (F.regexp_replace(o, r"\n$", "") == text))


def write_policy(exists: Column, ours: Column, forced: Column, certain: Column) -> Column:
    """saved, backup (a foreign file is kept once under another name), exists or error."""
    return classify.first_of([(~certain, "error"), (~exists | ours, "saved"), (forced, "backup")], "exists")


def staged(queries: DataFrame, key: str, stages: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each stage sees only the queries that no stage before answered; answers get their stage's number."""
    out, left = None, queries
    for i, stage in enumerate(stages):
        got = stage(left).withColumn("stage", F.lit(i))
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select(key).distinct(), key, "left_anti")
    return out


def original_priority(candidates: DataFrame, key: str, explicit: Column, local: Column, synced: Column, pos: str) -> DataFrame:
    """One source of a text for each key: given file, timed local, timed online, any local, online."""
    rank = F.when(explicit, 0).when(local & synced, 1).when(synced, 2).when(local, 3).otherwise(4)
    w = Window.partitionBy(key).orderBy(rank, pos)
    return candidates.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def job_status(found: Column, lang: Column, wanted: Column, done: Column, certain: Column) -> Column:
    """english (nothing to add), found, partial, notfound (certain) or failed (to be tried again)."""
    return classify.first_of([(~found & certain, "notfound"), (~found, "failed"), (lang == "en", "english"), (done >= wanted, "found")], "partial")


def accepts_collection(name: Column, title: Column, tracks: Column) -> Column:
    """Whether a catalog's collection may name a song's folder: no junk, no bare number or
    clock, and not the song's own single unless it holds more than two tracks."""
    bare = F.trim(name)
    single = (S.plain_key(bare) == S.plain_key(title)) & (F.coalesce(tracks, F.lit(0)) <= 2)
    return (bare != "") & ~bare.rlike(JUNK_COLLECTION) & ~bare.rlike(r"^[\d\s:.\-]+$") & ~S.is_placeholder(bare) & ~single


def collection_vote(candidates: DataFrame, key: str, name: str, title: str, tracks: str, pos: str) -> DataFrame:
    """The collection most candidates of a song agree on, of those accepted."""
    ok = candidates.where(accepts_collection(F.col(name), F.col(title), F.col(tracks)))
    return match.vote(ok.withColumn("__c", F.lower(F.trim(name))), key, "__c", name, pos)


def most_viewed_source(videos: DataFrame, key: str, channel: str, views: str, pos: str, pictures: DataFrame, top: int = 3) -> DataFrame:
    """The channel with most views in all, among the ``top`` of each key, that has a picture."""
    summed = videos.groupBy(key, channel).agg(F.sum(views).alias("views"), F.min(pos).alias("first_seen"))
    w = Window.partitionBy(key).orderBy(F.desc("views"), "first_seen")
    head = summed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).join(pictures, channel)
    return head.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).where("__r = 1").drop("__r")


def needs_lookup(tags_missing: Column, cached: Column) -> Column:
    """A lookup is due where a tag is missing and the cache knows nothing (an empty answer is known)."""
    return tags_missing & cached.isNull()


def same_language(text: Column) -> Column:
    """A service's answer that source and target are one language."""
    return F.lower(text).rlike(r"(?:same|equal|identical) (?:source|language)|two distinct languages|source and target")


def romanizer(lang: Column, line: Column, kana: Column, hangul: Column, cyrillic: Column) -> Column:
    """The romanization of a line by its own language; "" if it changes nothing."""
    which = S.line_language(line, lang)
    out = F.when(which == "ko", hangul).when(which == "ru", cyrillic).when(which == "ja", kana).otherwise("")
    return F.when(S.plain_key(out) == S.plain_key(line), "").otherwise(F.coalesce(out, F.lit("")))
