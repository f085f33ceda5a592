"""Ordered rule cascades: the first rule that holds names the class."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import scalars as S
from gleaner.functions import similar

#: Words of a live recording, and of a remix, in a name. Fixed values.
LIVE = ("boiler room", "live @", "live at", "dj set", "essential mix", "usb00", "b2b", "mixmag", "cercle")
REMIX = ("remix", "re-mix", "edit", "vip", "flip", "dub", "bootleg", "live", "acoustic", "instrumental", "version", "sped up", "slowed", "nightcore")
#: Patterns of faulty names. Fixed values.
GENERIC = r"(?i)^(?:track|audiotrack|audio|song|sound|recording|videoplayback|untitled|new recording|voice)[\s._-]*\d*$"
HEX = r"^[0-9a-fA-F_-]{1,16}$"
LEADING_TRACK = r"(?i)^(?:(?:cd|disc)?\s*\d{1,2}[-._\s]+|\d{1,3}[\s._-]+|\d{1,3}\s+).*$"
MEDIA = r"(?i)[\(\[](?:official\s*(?:video|audio|music\s*video|lyric\s*video|visualizer|clip|version)?|mv|hd|4k|hq|lyrics?|visualizer|audio|full\s*track|preview|teaser)[\)\]]"
WEBSITE = (
    r"(?i)\b(?:soundloadmate(?:\.com)?|y2mate(?:\.is|\.com)?|yt-dlp|freemp3(?:downloads)?|mp3juice|mp3clan|musicpleer|songslover|myfreemp3"
    r"|spotifydown|cobalt|loader\.to|qload|www\.[a-z0-9-]+\.[a-z]{2,}|\.com|\.net|\.org|\.ru|\.is|\.cc)\b"
)
JUNK = r"(?i)[\(\[](?:skip\s+to\b[^\]\)]*|320\s*kbps|128\s*kbps|256\s*kbps|flac|mp3|lossless|remaster(?:ed)?|rip|web-dl|dvdrip|cd\s*rip|v0|v2)[\)\]]"


def first_of(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds (null counts as not holding)."""
    out = reduce(lambda w, r: w.when(r[0], r[1]), rules[1:], F.when(*rules[0]))
    return out.otherwise(otherwise) if otherwise is not None else out


def holds_any(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in words))


def _missing(x: Column) -> Column:
    return x.isNull() | (x == "") | S.is_placeholder(x)


def name_issue(stem: Column, artist: Column | None = None, title: Column | None = None, stem_tokens: Column | None = None, tag_tokens: Column | None = None) -> Column:
    """What is wrong with a file's name, null if nothing: nine rules in order."""
    s = F.trim(stem)
    rules = [(s.rlike(GENERIC) | F.lower(s).rlike(HEX), "Generic or placeholder filename")]
    if artist is not None:
        rules += [(_missing(artist), "Missing artist tag"), (_missing(title), "Missing title tag")]
    rules += [
        (s.rlike(LEADING_TRACK), "Leading track number in filename"), (s.rlike(WEBSITE), "Website/ripper tag in filename"),
        (s.rlike(MEDIA), "Video/media annotation in filename"), (s.rlike(JUNK), "Junk annotation in filename"),
        (F.contains(s, F.lit("_")), "Underscores in filename"), (~s.rlike(r" (?:-|\||–|—) "), "Missing artist separator in filename"),
    ]
    if stem_tokens is not None:
        apart = (F.size(stem_tokens) > 0) & (F.size(tag_tokens) > 0) & ~F.arrays_overlap(stem_tokens, tag_tokens)
        rules.append((apart, "Filename does not match audio tags"))
    return first_of(rules)


def is_generic(stem: Column, artist: Column, title: Column) -> Column:
    s = F.trim(stem)
    whole = (F.trim(title) == s) & ~s.rlike(r" (?:-|\|) ")
    return F.coalesce(s.rlike(GENERIC) | F.lower(s).rlike(HEX) | _missing(artist) | _missing(title) | whole, F.lit(True))


def duration_status(local: Column, catalog: Column) -> Column:
    """REJECT_MIX, REJECT_SNIPPET or null, from two lengths; bounds of a whole catalog length are exact (0.4 * 84 is 33.6)."""
    known = (catalog > 0) & (local > 0)
    most, least = catalog * F.lit(Decimal("1.5")), catalog * F.lit(Decimal("0.4"))
    return first_of([(known & ((local > most) | (local - catalog > 60.0)), "REJECT_MIX"), (known & (local < least), "REJECT_SNIPPET")])


def evaluate_match(found: Column, time_skew: Column, freq_skew: Column, local: Column, catalog: Column, generic: Column, local_remix: Column, catalog_remix: Column, overlap: Column, issue: Column, tolerance: float = 6.0) -> Column:
    """struct(status, confidence, gap): guardrails first, then names; null lengths are unknown."""
    skew = F.coalesce(F.greatest(F.abs(time_skew), F.abs(freq_skew)), F.lit(0.0)) > 0.05
    gap = F.when((catalog > 0) & (local > 0), F.abs(local - catalog))
    length = duration_status(local, catalog)
    base = F.when(gap.isNull(), 0.85).when(gap <= tolerance, 1.0).when(gap <= 15.0, 0.88).otherwise(0.65)
    raised = F.when(base >= 0.85, 1.0).otherwise(base)
    status = first_of([(~F.coalesce(found, F.lit(False)), "NO_MATCH"), (skew, "REJECT_SKEW"), (length == "REJECT_MIX", "REJECT_MIX"), (length == "REJECT_SNIPPET", "REJECT_SNIPPET"),
                       (generic, "IDENTIFIED"), (local_remix & ~catalog_remix, "POTENTIAL_REMIX"), (~overlap, "MISLABELED")], "CONFIRMED")
    confidence = (
        F.when(status.isin("NO_MATCH", "REJECT_MIX"), 0.0).when(status.isin("REJECT_SKEW", "REJECT_SNIPPET"), 0.2)
        .when(status == "IDENTIFIED", raised).when(status == "POTENTIAL_REMIX", F.least(base, F.lit(0.70))).when((status == "CONFIRMED") & issue.isNotNull(), raised).otherwise(base)
    )
    return F.struct(status.alias("status"), confidence.alias("confidence"), F.when(~status.isin("NO_MATCH", "REJECT_SKEW"), gap).alias("gap"))


def match_bucket(status: Column, confidence: Column, least: float = 0.8) -> Column:
    return first_of([(status == "NO_MATCH", "none"), (status.startswith("REJECT"), "rejected"), (confidence >= least, "high")], "unsure")


def severe_mismatch(df: DataFrame, stem: str, title: str, name: str = "severe") -> DataFrame:
    """name: whether the title can't be that of the name (both without accents). Cheap rules stand first, then bounds of
    similarity; only names and words that these leave open are compared character by character."""
    low, tag = F.lower(stem), F.lower(title)
    keyed = df.withColumns({"__a": S.ascii_key(F.col(stem)), "__b": S.ascii_key(F.col(title)), "__x": S.core_words(F.col(stem)), "__y": S.core_words(F.col(title))})
    decided = (
        F.when(F.coalesce(F.col(title) == "", F.lit(True)) | F.coalesce(F.col(stem) == "", F.lit(True)), False)
        .when(S.is_cjk(F.col(stem)) | S.is_cjk(F.col(title)), False)
        .when(holds_any(low, LIVE) & ~holds_any(tag, LIVE), True)
        .when((F.col("__a") == "") | (F.col("__b") == ""), False)
        .when(F.contains("__a", "__b") | F.contains("__b", "__a"), False)
    )
    # steps of their own: an expression that held them all would repeat the keys in each place
    ruled = keyed.withColumn("__v", decided)
    bounded = similar.with_ratio_above(ruled.withColumns({"__a": F.when(F.col("__v").isNull(), F.col("__a")), "__b": F.when(F.col("__v").isNull(), F.col("__b"))}), "__a", "__b", 0.60, "__alike")
    none = (F.size("__x") == 0) | (F.size("__y") == 0)
    left = bounded.withColumn("__open", F.col("__v").isNull() & ~F.coalesce("__alike", F.lit(False)) & ~none)
    told = similar.with_words_alike(left, "__x", "__y", 0.75, "__open", "__near")
    return told.withColumn(name, F.coalesce("__v", F.col("__open") & ~F.col("__near"))).select(*df.columns, name)


def ticked(todo: Column, default: Column, ask_first: Column) -> Column:
    """A step is chosen if there is work (unknown: its default) unless it asks first."""
    return F.coalesce(todo, default) & ~ask_first
