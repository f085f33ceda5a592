"""Line-oriented texts: timed lines, plain lines, layers at one time, rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import scalars as S
from gleaner.operators.scan import Scan

#: Patterns of timed text and of credit lines. Fixed values.
STAMP = r"\[(\d+):(\d+(?:\.\d+)?)\]"
LEADING = r"^(?:\s*\[\d{1,3}:\d{1,2}(?:[.:]\d{1,3})?\])+"
LEADING_ONE = r"\[(\d{1,3}):(\d{1,2})(?:[.:](\d{1,3}))?\]"
META = r"^\s*\[[A-Za-z#]+:[^\]]*\]\s*$"
OFFSET = r"(?i)^\s*\[offset:\s*([+-]?\d+)\s*\]"
WORD_TIME = r"<\d{1,3}:\d{1,2}(?:[.:]\d{1,3})?>"
CREDIT = (
    r"(?iu)^\s*(?:作词|作詞|作曲|编曲|編曲|词曲|詞曲|制作人|制作|監修|监制|混音|录音|母带|词|詞|曲|작사|작곡|편곡|lyrics?(?:\s+by)?|music(?:\s+by)?|composer"
    r"|composed\s+by|arranger|arranged\s+by|written\s+by|words(?:\s+by)?|lyricist|producer|produced\s+by)\s*[:：]"
)


def lines(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, pos, line): all lines of a text; null texts have none."""
    return df.select(*key, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("pos", "line"))


def timed_lines(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, time, pos, idx, text): a row for each stamp anywhere in a line; other lines go."""
    each = lines(df, key, text)
    stamps = F.arrays_zip(F.regexp_extract_all("line", F.lit(STAMP), F.lit(1)).alias("m"), F.regexp_extract_all("line", F.lit(STAMP), F.lit(2)).alias("s"))
    body = F.trim(F.regexp_replace("line", STAMP, ""))
    each = each.select(*key, "pos", body.alias("text"), F.posexplode(stamps).alias("idx", "z"))
    return each.select(*key, (F.col("z.m").cast("double") * 60 + F.col("z.s").cast("double")).alias("time"), "pos", "idx", "text")


def plain_lines(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, pos, text): trimmed lines; runs of blank lines become one, none at the ends."""
    each = lines(df, key, text).select(*key, "pos", F.trim("line").alias("text"))
    w = Window.partitionBy(*key).orderBy("pos")
    last = F.max(F.when(F.col("text") != "", F.col("pos"))).over(Window.partitionBy(*key))
    each = each.withColumn("__before", F.lag("text").over(w)).withColumn("__last", last)
    return each.where("(text <> '' or coalesce(__before, '') <> '') and pos <= __last").drop("__before", "__last")


def local_lines(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, synced, time, pos, idx, text): leading stamps, offsets and word times understood.

    A text is synced with at least two stamped and two spoken rows, stamps on half its lines.
    """
    each = lines(df, key, text).withColumn("line", F.regexp_replace("line", "﻿", ""))
    w = Window.partitionBy(*key)
    offset = F.when(F.col("line").rlike(OFFSET), F.regexp_extract("line", OFFSET, 1).cast("double") / 1000)
    each = each.withColumn("offset", F.coalesce(F.max(F.struct(offset.isNotNull().alias("k"), "pos", offset.alias("v"))).over(w)["v"], F.lit(0.0)))
    each = each.where(~F.col("line").rlike(OFFSET) & ~F.col("line").rlike(META))
    head = F.regexp_extract("line", LEADING, 0)
    body = S.squeeze(F.regexp_replace(F.regexp_replace("line", LEADING, ""), WORD_TIME, ""))

    def at(i: int) -> Column:
        return F.regexp_extract_all(head, F.lit(LEADING_ONE), F.lit(i))

    def seconds(z: Column) -> Column:
        part = F.coalesce(z["f"].cast("double") / F.pow(F.lit(10.0), F.length(z["f"])), F.lit(0.0))
        return z["m"].cast("double") * 60 + z["s"].cast("double") + F.when(z["f"] == "", 0.0).otherwise(part)

    times = F.transform(F.arrays_zip(at(1).alias("m"), at(2).alias("s"), at(3).alias("f")), seconds)
    each = each.select(*key, "pos", "offset", body.alias("text"), times.alias("times"))
    n = F.size("times")
    stamped, spoken, total = F.sum(n).over(w), F.sum(F.when(F.col("text") != "", n).otherwise(0)).over(w), F.count(F.lit(1)).over(w)
    each = each.withColumn("synced", (stamped >= 2) & (spoken >= 2) & (stamped >= 0.5 * total))
    timed = each.where("synced").select(*key, "synced", "offset", "pos", "text", F.posexplode("times").alias("idx", "t"))
    timed = timed.select(*key, "synced", F.greatest(F.lit(0.0), F.col("t") - F.col("offset")).alias("time"), "pos", "idx", "text")
    order = Window.partitionBy(*key).orderBy("pos")
    last = F.max(F.when(F.col("text") != "", F.col("pos"))).over(w)
    plain = each.where("not synced").withColumn("b", F.lag("text").over(order)).withColumn("l", last).where("(text <> '' or coalesce(b, '') <> '') and pos <= l")
    return timed.unionByName(plain.select(*key, "synced", F.lit(None).cast("double").alias("time"), "pos", F.lit(0).alias("idx"), "text"))


def runs(df: DataFrame, key: list[str], order: list[str], value: str, run: str = "run") -> DataFrame:
    """Numbers runs of equal consecutive values; nulls never join a run."""
    s = Scan(df, key, order).add(__before=("lag", F.col(value)))
    s = s.compute(__new=F.coalesce((F.col(value) != F.col("__before")).cast("long"), F.lit(1)))
    return s.add(**{run: ("sum", F.col("__new"))}).df.drop("__before", "__new")


def fold_layers(df: DataFrame, key: list[str], order: list[str], time: str = "time", text: str = "text") -> DataFrame:
    """(key, run, time, text, romaji, english): lines at one time folded into one.

    A document is layered if at least two runs, and half of those with text, hold two or
    more texts; the k-th texts of its runs together decide what they are.
    """
    r = runs(df, key, order, time)
    spoken = r.where(F.col(text) != "").withColumn("k", F.row_number().over(Window.partitionBy(*key, "run").orderBy(*order)))
    per_run = spoken.groupBy(*key, "run").agg(F.max("k").alias("deep"))
    doc = per_run.groupBy(*key).agg(F.count_if(F.col("deep") >= 2).alias("layered"), F.count(F.lit(1)).alias("talking"))
    doc = doc.select(*key, (F.col("layered") >= F.greatest(F.lit(2.0), F.col("talking") / 2)).alias("folds"))
    spoken = spoken.join(doc, key)
    kinds = spoken.where("folds and k > 1").groupBy(*key, "k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", text))), lambda x: x[text]), "\n").alias("all"))
    kinds = kinds.select(*key, "k", S.classify_layer(F.col("all")).alias("kind"))
    spoken = spoken.join(kinds, [*key, "k"], "left")

    def pick(kind: str) -> Column:
        return F.coalesce(F.min(F.when(F.col("kind") == kind, F.struct("k", text)))[text], F.lit(""))

    folded = spoken.where("folds").groupBy(*key, "run").agg(F.first(time).alias("time"), F.min(F.struct("k", text))[text].alias("text"), pick("romanization").alias("romaji"), pick("english").alias("english"))
    flat = r.join(doc.where("folds"), key, "left_anti").select(*key, "run", F.col(time).alias("time"), F.col(text).alias("text"), F.lit("").alias("romaji"), F.lit("").alias("english"))
    silent = r.join(doc.where("folds"), key, "left_semi").where(F.coalesce(F.col(text), F.lit("")) == "").join(per_run, [*key, "run"], "left_anti")
    silent = silent.select(*key, "run", F.col(time).alias("time"), F.col(text).alias("text"), F.lit("").alias("romaji"), F.lit("").alias("english"))
    return folded.unionByName(flat).unionByName(silent)


def strip_credits(df: DataFrame, key: list[str], pos: str, text: str, headers: Column, most: int = 8) -> DataFrame:
    """Drops leading lines (at most ``most``) that are blank, credits or a header key; all stay if none would be left."""
    w = Window.partitionBy(*key).orderBy(pos)
    goes = (F.coalesce(F.col(text), F.lit("")) == "") | F.col(text).rlike(CREDIT) | F.array_contains(headers, S.plain_key(F.col(text)))
    df = df.withColumn("__n", F.row_number().over(w)).withColumn("__stays", ~F.coalesce(goes, F.lit(False)))
    first = F.min(F.when(F.col("__stays"), F.col("__n"))).over(Window.partitionBy(*key))
    total = F.count(F.lit(1)).over(Window.partitionBy(*key))
    df = df.withColumn("__cut", F.least(F.coalesce(first, total + 1) - 1, F.lit(most))).withColumn("__total", total)
    return df.where("__n > __cut or __cut = __total").drop("__n", "__stays", "__cut", "__total")


def shown(line: Column, layers: tuple[str, ...]) -> Column:
    """Texts of the chosen layers, the original if they have none."""
    some = F.filter(F.array(*(F.coalesce(line[x], F.lit("")) for x in layers)), lambda t: t != "")
    own = F.filter(F.array(F.coalesce(line["text"], F.lit(""))), lambda t: t != "")
    return F.when(F.size(some) > 0, some).otherwise(own)


def render_timed(rows: Column, layers: tuple[str, ...] = ("text", "romaji", "english"), title: Column | None = None, artist: Column | None = None, by: str = "gleaner") -> Column:
    """array<struct(time, text, romaji, english)> -> timed text."""
    def one(x: Column) -> Column:
        stamp = F.concat(F.lit("["), S.timestamp(x["time"]), F.lit("]"))
        return F.when(F.coalesce(x["text"], F.lit("")) == "", F.array(stamp)).otherwise(F.transform(shown(x, layers), lambda t: F.concat(stamp, t)))

    body = F.flatten(F.transform(F.filter(rows, lambda x: x["time"].isNotNull()), one))
    heads = [F.when(c.isNotNull() & (c != ""), F.array(F.concat(F.lit(f"[{k}:"), S.squeeze(c), F.lit("]")))).otherwise(F.array().cast("array<string>")) for k, c in (("ti", title), ("ar", artist)) if c is not None]
    parts = [*heads, F.array(F.lit(f"[by:{by}]")), body]
    return F.concat(F.array_join(reduce(lambda a, b: F.concat(a, b), parts), "\n"), F.lit("\n"))


def render_plain(rows: Column, layers: tuple[str, ...] = ("text", "romaji", "english")) -> Column:
    return F.concat(F.array_join(F.flatten(F.transform(rows, lambda x: F.when(F.size(shown(x, layers)) > 0, shown(x, layers)).otherwise(F.array(F.lit(""))))), "\n"), F.lit("\n"))


def data_block(rows: Column) -> Column:
    """Rows as JSON that may stand in a page: ``<`` is written as its escape."""
    return F.regexp_replace(F.to_json(rows), "<", r"\\\\u003c")


def parse_data_block(page: Column, schema: str, block_id: str = "data") -> Column:
    inner = F.regexp_extract(page, rf'(?s)<script[^>]*id="{block_id}"[^>]*>(.*?)</script>', 1)
    return F.from_json(inner, schema)


def render_html(title: Column, rows: Column, block_id: str = "data") -> Column:
    def safe(x: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<p>"), safe(F.coalesce(r["text"], F.lit(""))), F.lit("</p>"))), "\n")
    return F.concat(F.lit("<!doctype html><title>"), safe(title), F.lit("</title>\n"), body, F.lit(f'\n<script type="application/json" id="{block_id}">'), data_block(rows), F.lit("</script>\n"))
