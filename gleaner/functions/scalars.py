"""Scalar text functions as Column expressions: they stay in the JVM.

Patterns use explicit classes (``\\p{L}``, ``\\p{N}``), as ``\\w`` means other things
in other engines. Functions that need Unicode normalization take columns that
``gleaner.functions.unicode`` has prepared.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that say "nothing here". Fixed values.
PLACEHOLDERS = ("unknown", "unknown album", "unknown artist", "null", "none", "n/a", "na", "nan", "<unknown>", "untitled")
NOT_AN_ARTIST = ("various artists", "various", "va", "unknown", "unknown artist", "artist", "n a", "none")
ODD_NAMES = ("null", "none", "undefined", "unknown", "unknown album", "unknown artist", "untitled", "various")
JUNK_FILES = (".ds_store", "thumbs.db", "desktop.ini")
#: Frequent English words. Fixed values.
ENGLISH_WORDS = tuple(
    "the a an and or but if of to in on at for with from by as is are was were be been am i you he she it we "
    "they me my your his her its our their this that these those not no yes so do does did just like up out all "
    "what when who how will can got get gonna wanna oh yeah baby love know now never ever more one there here "
    "say too then than into over back down".split()
)
#: Words of a song's annotation (any place inside a word counts). Fixed values.
ANNOTATIONS = ("remix", "re-mix", "edit", "vip", "dub", "acoustic", "instrumental", "version", "flip")
STOPWORDS = (
    "the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "of", "with", "by", "from",
    "feat", "ft", "remix", "re-mix", "mix", "edit", "vip", "dub", "version", "original", "flac", "mp3",
)
TOKEN_STOPWORDS = ("the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "of", "with", "by", "official", "video", "audio")
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{x}{i}" for x in ("COM", "LPT") for i in range(1, 10)))
FORMAT_TABLE = {  # extension: name, lossless, worth of a kbps; fixed values
    "flac": ("FLAC", True, 1.0), "wav": ("WAV", True, 1.0), "mp3": ("MP3", False, 1.0), "m4a": ("AAC", False, 1.25), "mp4": ("AAC", False, 1.25),
    "aac": ("AAC", False, 1.25), "ogg": ("Vorbis", False, 1.15), "opus": ("Opus", False, 1.5),
}
QUALITY_STEP = 1.08
LANGUAGES = {
    "ja": "Japanese", "ko": "Korean", "zh": "Chinese", "es": "Spanish", "fr": "French", "de": "German", "it": "Italian", "pt": "Portuguese",
    "ru": "Russian", "uk": "Ukrainian", "ar": "Arabic", "hi": "Hindi", "th": "Thai", "tr": "Turkish", "id": "Indonesian", "vi": "Vietnamese",
    "nl": "Dutch", "sv": "Swedish", "pl": "Polish", "el": "Greek", "he": "Hebrew", "fa": "Persian", "tl": "Filipino", "fil": "Filipino",
    "bn": "Bengali", "ta": "Tamil", "ms": "Malay", "ro": "Romanian", "cs": "Czech", "hu": "Hungarian", "fi": "Finnish", "da": "Danish",
    "no": "Norwegian", "la": "Latin", "sw": "Swahili", "af": "Afrikaans",
}


def _or_null(x: Column) -> Column:
    return F.when(x != "", x)


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[\s　]+", " "))


def plain_key(x: Column) -> Column:
    """Lower case letters and digits: the key where no Unicode folding is needed."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")


def words(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def name_key(folded: Column) -> Column:
    return F.coalesce(_or_null(F.array_join(words(folded), " ")), F.trim(folded))


def match_score(q: Column, t: Column) -> Column:
    """0 if a list is empty, 1 for equal lists, else the sets' Jaccard similarity, 0.99 at most."""
    share = F.size(F.array_intersect(q, t)) / F.size(F.array_union(q, t))
    return F.when((F.size(q) == 0) | (F.size(t) == 0), 0.0).when(q == t, 1.0).otherwise(F.least(share, F.lit(0.99)))


def artist_score(a_key: Column, b_key: Column, a_words: Column, b_words: Column) -> Column:
    """1 if one key holds the other, else ``match_score``."""
    inside = (a_key != "") & (b_key != "") & (F.contains(a_key, b_key) | F.contains(b_key, a_key))
    return F.when(inside, 1.0).otherwise(match_score(a_words, b_words))


#: Patterns of variant marks, decoration and upload noise in titles. Fixed values.
_MARK = r"re-?mix(?:ed)?|live|acoustic|instrumental"
_DECORATION = (
    r"(?iu)\bslowed(?:\s*[+&]\s*|\s+and\s+)reverb\b|\bsped[\s-]?up\b|\bslowed(?:\s+down)?\b|\breverb\b|\bnightcore\b"
    r"|\b8d(?:\s+audio)?\b|\bextended(?:\s+(?:mix|version|edit))?\b"
)
_BRACKETED = rf"(?iu)[\(\[][^\)\]]*\b(?:{_MARK})\b[^\)\]]*[\)\]]"
_TRAILING = rf"(?iu)[\s\-–—]+(?:{_MARK})\s*$"
_NOISE = r"(?iu)\[[A-Za-z0-9_-]{11}\]|\((?:official|lyric|lyrics|audio|video|music video|visualizer|hd|4k|explicit)[^)]*\)"
_TAIL_NOISE = (
    r"(?iu)[\s\-–|:]*(?:official(?:\s+(?:music\s+)?(?:video|audio|mv|lyric\s+video|channel))?|music\s+video|lyric\s+video"
    r"|lyrics?|mv|audio|hd|4k|試聴動画|公式)\s*$"
)


def tidy_title(clean: Column, passes: int = 3) -> Column:
    """A title without upload noise and variant decoration."""
    for _ in range(passes):
        for pattern, put in ((_NOISE, " "), (_TAIL_NOISE, ""), (_BRACKETED, " "), (_TRAILING, ""), (_DECORATION, " ")):
            clean = F.regexp_replace(clean, pattern, put)
        clean = squeeze(clean)
    return clean


def variant_markers(clean: Column) -> Column:
    """Sorted distinct words that mark a deliberate variant."""
    spans = reduce(lambda a, b: F.concat(a, b), [F.regexp_extract_all(clean, F.lit(p), F.lit(0)) for p in (_BRACKETED, _TRAILING, _DECORATION)])
    word = rf"(?iu)\b(?:{_MARK}|sped[\s-]?up|slowed|reverb|nightcore|8d|extended)\b"
    found = F.flatten(F.transform(spans, lambda s: F.regexp_extract_all(s, F.lit(word), F.lit(0))))
    plain = F.transform(found, lambda w: F.regexp_replace(F.lower(w), r"[\s-]", ""))
    return F.array_sort(F.array_distinct(F.transform(plain, lambda w: F.when(w.startswith("remix"), F.lit("remix")).otherwise(w))))


def tidy_song_title(nfc: Column) -> Column:
    """A title without bracketed groups; what is inside, where nothing else is left."""
    def trimmed(x: Column) -> Column:
        return F.regexp_replace(squeeze(x), r"^[ \-_]+|[ \-_]+$", "")

    bare = trimmed(F.regexp_replace(nfc, r"[\(\[（【][^\)\]）】]*[\)\]）】]", " "))
    inner = trimmed(F.regexp_replace(nfc, r"^\s*[\(\[（【]\s*|\s*[\)\]）】]\s*$", ""))
    return F.coalesce(_or_null(bare), _or_null(inner), trimmed(nfc))


def first_artist(x: Column) -> Column:
    return F.trim(F.split(x, r"(?iu)\s*(?:;|,|&|/|\bfeat\.?|\bft\.?|\bfeaturing\b)\s*", 2)[0])


def clean_query_title(x: Column) -> Column:
    bare = F.trim(F.regexp_replace(x, r"[\(\[\{].*?[\)\]\}]", ""))
    bare = F.trim(F.regexp_replace(bare, r"(?iu)\s+(?:feat\.?|ft\.?|featuring)\s+.*$", ""))
    return F.coalesce(_or_null(bare), x)


def split_artists(clean: Column) -> Column:
    parts = F.transform(F.split(clean, r"(?iu)\s*;\s*|\x00|\s+(?:feat\.?|ft\.?|featuring)\s+"), F.trim)
    return F.filter(parts, lambda p: (p != "") & (F.char_length(p) <= 80) & ~name_key(F.lower(p)).isin(*NOT_AN_ARTIST))


def name_parts(name: Column) -> Column:
    """Parts of a combination ("A & B"), none if there is one name."""
    pattern = r"(?iu)\s+(?:&|and|x|\+|vs\.?|with|as)\s+|\s*[&＆×/、]\s*|,\s+|\s+(?:feat|ft|featuring|vo)\.\s*|\s+(?:feat|ft|featuring)\s+"
    parts = F.filter(F.transform(F.split(name, pattern), F.trim), lambda p: p != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


_TOPIC = r"(?iu)\s+-\s+Topic$"


def alias_names(name: Column) -> Column:
    inside = F.regexp_extract_all(F.regexp_replace(name, _TOPIC, ""), F.lit(r"(?iu)[\(\[（【]\s*(?:CV\s*[:.：．]\s*)?(.*?)\s*[\)\]）】]"), F.lit(1))
    return F.filter(F.transform(inside, F.trim), lambda a: a != "")


def artist_variants(name: Column) -> Column:
    """The name, the name without brackets, then what was in them; distinct, in order."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, _TOPIC, ""), r"\s*[\(\[（【].*?[\)\]）】]", ""))
    return F.filter(F.array_distinct(F.concat(F.array(name, bare), alias_names(name))), lambda x: x != "")


def query_variants(pairs: Column, most: int = 6) -> Column:
    """array<struct<artist, title>> -> the first ``most`` with a title that differ without case."""
    pairs = F.filter(F.transform(pairs, lambda p: F.struct(F.trim(F.coalesce(p["artist"], F.lit(""))).alias("artist"), squeeze(F.coalesce(p["title"], F.lit(""))).alias("title"))), lambda p: p["title"] != "")
    keys = F.transform(pairs, lambda p: F.lower(F.concat_ws("\x00", p["artist"], p["title"])))
    zipped = F.arrays_zip(pairs.alias("p"), F.transform(keys, lambda k: F.array_position(keys, k)).alias("at"))
    firsts = F.filter(F.transform(zipped, lambda z: z), lambda z, i: z["at"] == i + 1)
    return F.slice(F.transform(firsts, lambda z: z["p"]), 1, most)


def is_placeholder(x: Column) -> Column:
    return F.lower(F.trim(x)).isin(*PLACEHOLDERS)


def is_odd_name(x: Column) -> Column:
    return F.lower(F.trim(x)).isin(*ODD_NAMES) | (plain_key(x) == "")


def is_junk_file(name: Column) -> Column:
    return name.startswith("._") | F.lower(name).isin(*JUNK_FILES)


def is_backup_file(name: Column) -> Column:
    return F.lower(name).endswith(".lrc.bak") & ~name.startswith("._")


def windows_safe(name: Column) -> Column:
    return F.when(F.upper(F.split(name, r"\.")[0]).isin(*RESERVED), F.concat(F.lit("_"), name)).otherwise(name)


def safe_filename(clean: Column) -> Column:
    text = F.ltrim(F.lit("."), F.trim(F.regexp_replace(clean, r'[\\/:*?"<>|\x00-\x1f]', "_")))
    return F.coalesce(_or_null(F.trim(F.substring(text, 1, 120))), F.lit("artist"))


def is_cjk(x: Column) -> Column:
    return x.rlike(r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]")


def is_song_annotation(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return low.rlike(r"^(?:feat|ft)[. ]") | reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in ANNOTATIONS))


def parse_filename(stem: Column) -> Column:
    """struct(pattern, stem, rest, track, artist, title, details) of a file's name without its ending."""
    stem = F.trim(stem)
    numbered = r"^(\d{1,3})(?:\s*[-–—\.]\s*|\s+)(.*)$"
    has_number = stem.rlike(numbered)
    track = F.when(has_number, F.regexp_extract(stem, numbered, 1))
    rest = F.when(has_number, F.trim(F.regexp_extract(stem, numbered, 2))).otherwise(stem)
    dashed, closed = r"^(.*?)\s+(?:[-–—]{1,2}|[|｜])\s+(.*)$", r"^(.*?)\s+([\(\{\[])(.*)([\)\}\]])$"
    left, right = (F.trim(F.regexp_extract(rest, dashed, i)) for i in (1, 2))
    before, inside = (F.trim(F.regexp_extract(rest, closed, i)) for i in (1, 3))
    is_dash = (left != "") & (right != "")
    is_closed = (before != "") & (inside != "")
    none = F.lit(None).cast("string")

    def case(a: Column, b: Column, c: Column, d: Column) -> Column:
        return F.when(is_dash, a).when(is_closed & is_song_annotation(inside), b).when(is_closed, c).otherwise(d)

    return F.struct(
        case(F.lit("artist_dash_title"), F.lit("title_with_annotation"), F.lit("artist_paren_details"), F.lit("raw")).alias("pattern"),
        stem.alias("stem"), rest.alias("rest"), track.alias("track"),
        case(left, none, before, none).alias("artist"),
        case(right, rest, inside, F.coalesce(_or_null(rest), stem)).alias("title"),
        case(none, inside, inside, none).alias("details"),
    )


def proposed_tags(parsed: Column, folder: Column, title_mode: str = "auto", update_artist: bool = True, album_mode: str = "keep") -> Column:
    """struct(title, artist, album, track). An empty album clears the tag, null leaves it."""
    auto = (
        F.when(parsed["pattern"] == "artist_dash_title", parsed["title"])
        .when((parsed["pattern"] == "title_with_annotation") | ((parsed["pattern"] == "raw") & parsed["track"].isNotNull()), parsed["rest"])
        .otherwise(parsed["stem"])
    )
    title = {"stem": parsed["stem"], "parsed": parsed["title"], "auto": auto}.get(title_mode, parsed["stem"])
    none = F.lit(None).cast("string")
    album = {"folder": folder, "title": title, "clear": F.lit("")}.get(album_mode, none)
    return F.struct(title.alias("title"), (parsed["artist"] if update_artist else none).alias("artist"), album.alias("album"), parsed["track"].cast("int").cast("string").alias("track"))


_LEADING_NUMBER = r"^(\d{1,3})[\s\.\-_]+"


def core_words(unmarked: Column) -> Column:
    """Words that carry a title's meaning, from a text without combining marks."""
    text = F.lower(F.regexp_replace(unmarked, _LEADING_NUMBER, ""))
    return F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))), F.array(*map(F.lit, STOPWORDS)))


def ascii_key(unmarked: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(unmarked, _LEADING_NUMBER, ""), "[^a-zA-Z0-9]+", ""))


def tokens(unmarked: Column) -> Column:
    found = F.regexp_extract_all(F.lower(unmarked), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*TOKEN_STOPWORDS) & (F.char_length(w) > 1)))


#: Character classes of scripts, in the order they are tried. Fixed values.
SCRIPTS = {
    "kana": r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}",
    "hangul": r"\x{AC00}-\x{D7FF}\x{1100}-\x{11FF}\x{3130}-\x{318F}",
    "han": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}",
    "cyrillic": r"\x{0400}-\x{04FF}",
}


def script_counts(x: Column) -> dict[str, Column]:
    """Letters of each script; latin and other are letters of no other script."""
    return _counts(*_parts(x))


def _parts(x: Column) -> tuple[Column, Column]:
    """How many ASCII letters there are, and what isn't ASCII: only that meets the scripts' patterns. Runs are taken out, not single characters."""
    return F.char_length(F.regexp_replace(x, "[^A-Za-z]++", "")), F.regexp_replace(x, r"[\x00-\x7F]++", "")


def _counts(ascii_letters: Column, left: Column) -> dict[str, Column]:
    out = {name: F.char_length(F.regexp_replace(left, f"[^{pattern}]++", "")) for name, pattern in SCRIPTS.items()}
    rest = "".join(SCRIPTS.values())
    latin = rf"\p{{L}}&&[\x{{0080}}-\x{{024F}}\x{{1E00}}-\x{{1EFF}}]&&[^{rest}]"
    out["latin"] = ascii_letters + F.char_length(F.regexp_replace(left, f"[^[{latin}]]++", ""))
    out["other"] = F.char_length(F.regexp_replace(F.regexp_replace(left, r"[^\p{L}]++", ""), rf"[{rest}\x{{0080}}-\x{{024F}}\x{{1E00}}-\x{{1EFF}}]++", ""))
    return out


def bound(x: Column, f) -> Column:
    """f of x, with x computed once however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def guess_language(x: Column, folded: Column | None = None, foreign: float = 0.15, english: float = 0.25) -> Column:
    """ja, ko, zh, ru or en where the writing tells, else und. x in NFC; folded for English words."""
    w = words(F.lower(x) if folded is None else folded)
    hits = bound(w, lambda v: F.struct(F.size(v).alias("words"), F.size(F.filter(v, lambda t: t.isin(*ENGLISH_WORDS))).alias("hits")))
    plain, left = _parts(x)
    scripts = bound(F.struct(plain.alias("plain"), left.alias("left")), lambda p: F.struct(*(n.alias(name) for name, n in _counts(p["plain"], p["left"]).items())))
    seen = F.struct(scripts.alias("scripts"), hits.alias("english"))

    def told(both: Column) -> Column:
        c, words_seen = both["scripts"], both["english"]
        letters = reduce(lambda a, b: a + b, (c[name] for name in (*SCRIPTS, "latin", "other")))
        by_script = (
            F.when(c["hangul"] > c["kana"] + c["han"], "ko").when(c["kana"] > 0, "ja").when((c["cyrillic"] > 0) & (c["cyrillic"] >= c["other"]), "ru")
            .when((c["han"] > 0) & (c["han"] >= c["other"]), "zh").otherwise("und")
        )
        by_words = F.when((words_seen["words"] > 0) & (words_seen["hits"] / words_seen["words"] >= english), "en").otherwise("und")
        return F.when(letters == 0, "en").when((letters - c["latin"]) / letters >= foreign, by_script).otherwise(by_words)

    return bound(seen, told)


def line_language(x: Column, song: Column) -> Column:
    c = script_counts(x)
    return F.when(c["hangul"] > 0, "ko").when(c["kana"] > 0, "ja").when(c["han"] > 0, F.when(song.isin("ja", "zh"), song).otherwise("")).when(c["cyrillic"] > 0, "ru").otherwise("")


def classify_layer(joined: Column) -> Column:
    """english, romanization (Latin letters, no accents but macrons) or other."""
    letters = F.regexp_replace(joined, r"[^\p{L}]", "")
    plain = F.char_length(F.regexp_replace(letters, "[^A-Za-zāīūēōĀĪŪĒŌ]", ""))
    lang = guess_language(joined)
    roman = (F.char_length(letters) > 0) & (plain / F.char_length(letters) >= 0.97) & (lang == "und")
    return F.when(lang == "en", "english").when(roman, "romanization").otherwise("other")


def language_name(code: Column) -> Column:
    head = F.lower(F.split(F.coalesce(code, F.lit("")), "-")[0])
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(names[head], F.when(head.isin("", "und"), "Unknown language").otherwise(F.upper(head)))


def timestamp(seconds: Column) -> Column:
    """mm:ss.xx, half-even."""
    c = F.rint(F.greatest(F.lit(0.0), seconds) * 100).cast("long")
    return F.format_string("%02d:%02d.%02d", F.floor(c / 6000), F.floor(c % 6000 / 100), c % 100)


def minutes_rounded(seconds: Column) -> Column:
    """m:ss, half-even."""
    s = F.rint(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def minutes_cut(seconds: Column) -> Column:
    """m:ss, fractions dropped; --:-- for null."""
    s = F.floor(seconds)
    return F.coalesce(F.when(seconds.isNotNull(), F.format_string("%d:%02d", F.floor(s / 60), s % 60)), F.lit("--:--"))


def _tenth_met(part: Column, k: int) -> Column:
    """Whether a fraction, exact as a double, rounds to (k + 1) tenths or more; half-even."""
    half = Fraction(2 * k + 1, 20)
    near = float(half)
    # where the double next to the half is above it, or is a tie that goes up to an even tenth, it counts
    return part >= near if Fraction(near) > half or (Fraction(near) == half and k % 2) else part > near


def one_decimal(x: Column) -> Column:
    """Text of a number of 1 or more with one decimal, as C's %.1f: exact value, ties to even (format_string rounds ties up, and by its shortest digits)."""
    whole = F.floor(x)
    tenths = bound(x - whole, lambda part: reduce(lambda a, b: a + b, (_tenth_met(part, k).cast("long") for k in range(10))))
    return bound(whole * 10 + tenths, lambda t: F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string")))


def human_size(n: Column) -> Column:
    out = F.when(n < 1024, F.format_string("%d B", F.rint(n).cast("long")))
    for k, unit in ((1, "KB"), (2, "MB")):
        out = out.when(n < 1024 ** (k + 1), F.concat(one_decimal(n / float(1024**k)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(one_decimal(n / float(1024**3)), F.lit(" GB")))


def compact(n: Column) -> Column:
    def short(size: int, suffix: str) -> Column:
        return F.concat(F.regexp_replace(F.format_string("%.1f", n / float(size)), r"\.?0$", ""), F.lit(suffix))

    return F.when(n >= 1_000_000, short(1_000_000, "M")).when(n >= 1_000, short(1_000, "K")).otherwise(n.cast("string"))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s"))


def audio_quality(ext: Column, codec: Column, bits: Column, rate: Column, bitrate: Column, size: Column, duration: Column) -> Column:
    """struct(lossless int, level long, tagged boolean): larger is better, field by field."""
    fmt = F.create_map(*(x for k, (_, l, w) in FORMAT_TABLE.items() for x in (F.lit(k), F.struct(F.lit(l).alias("lossless"), F.lit(w).alias("worth")))))[ext]
    lossless = F.coalesce(fmt["lossless"], F.lit(False)) | F.coalesce(codec == "alac", F.lit(False))
    stated = F.coalesce(bitrate, F.lit(0)) / 1000
    kbps = F.when(stated > 0, stated).when(F.coalesce(duration, F.lit(0)) > 0, size * 8 / duration / 1000).otherwise(0.0)
    level = F.rint(F.ln(F.greatest(kbps * F.coalesce(fmt["worth"], F.lit(1.0)), F.lit(1.0))) / F.ln(F.lit(QUALITY_STEP))).cast("long")
    exact = (F.coalesce(F.when(bits > 0, bits), F.lit(16)) * F.coalesce(F.when(rate > 0, rate), F.lit(44100))).cast("long")
    return F.struct(lossless.cast("int").alias("lossless"), F.when(lossless, exact).otherwise(level).alias("level"), ~(lossless & (ext == "wav")).alias("tagged"))


def search_link(base: str, *parts: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(F.concat_ws(" ", *parts)))


def looks_translated(source: Column, result: Column) -> Column:
    """At least a tenth of the lines with letters differ in the result; true if there are none."""
    both = F.filter(F.arrays_zip(source.alias("s"), result.alias("r")), lambda z: z["s"].rlike(r"\p{L}"))
    changed = F.size(F.filter(both, lambda z: plain_key(z["s"]) != plain_key(z["r"])))
    return (F.size(both) == 0) | (changed / F.size(both) >= 0.1)
