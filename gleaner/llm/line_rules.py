"""Quality rules, line first: bad lines go, then documents that lose too much text.

Every line that has a word is judged on its own:

- punctuation: symbol characters (``# * $ % & | < >``) and doubled marks (``!!``)
  come to at least ``max_symbols`` a word, or a line of at least ``bare_words``
  words has none of ``. , ; : ! ?``;
- navigation: separators (``|`` ``>``) stand alone in at least a fifth of the
  words, or a line of at most three words is made of menu words;
- boilerplate: it has at most ``boiler_words`` words and holds a stock phrase
  (rights, cookies, licences, scripts), or it equals an earlier line, or at least
  ``max_stutter`` of its words repeat the word before.

Lines that fail are removed, each with one line feed: the one after it, or the one
before it where it ends the text; all others stay. A document is rejected if it has no words, if the
removed lines held more than ``max_lost`` of its characters in words, or if it
fails the base rule (fewer than ``min_words`` words, or more than half of its
words in repeated 3-word windows).

Defined cases: a null text has no words and is rejected; texts of white space
too. Whole texts are read, whatever their length. Equal rows get equal results;
other columns are ignored by ``judge`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words as W

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MARKS = np.zeros(256, bool)
MARKS[list(b".,;:!?")] = True
#: Fixed phrases of boilerplate lines in English, German, French and Spanish, lower case.
PHRASES = tuple(p.encode() for p in (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "enable javascript", "is licensed under", "licensed under", "released under the", "lorem ipsum",
    "subscribe to our", "sign up for", "click here", "read more", "powered by",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutz", "impressum", "verwendet cookies", "javascript aktivieren",
    "lizenziert unter", "newsletter abonnieren", "hier klicken", "mehr erfahren", "weiterlesen",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "mentions légales", "utilise des cookies",
    "activer javascript", "sous licence", "cliquez ici", "lire la suite", "en savoir plus",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "aviso legal", "utiliza cookies",
    "habilitar javascript", "bajo licencia", "haga clic aquí", "leer más", "suscríbete a",
))
#: Fixed menu words of navigation lines in the same languages, lower case.
MENU = frozenset(m.encode() for m in (
    "home", "menu", "login", "logout", "search", "next", "previous", "prev", "back", "top", "contact", "about", "help", "share", "sitemap", "skip",
    "startseite", "menü", "anmelden", "abmelden", "suche", "weiter", "zurück", "kontakt", "hilfe", "teilen",
    "accueil", "connexion", "déconnexion", "recherche", "suivant", "précédent", "retour", "aide", "partager",
    "inicio", "menú", "entrar", "salir", "buscar", "siguiente", "anterior", "volver", "contacto", "ayuda", "compartir",
))
_PHRASE = re.compile(b"|".join(map(re.escape, PHRASES)))
_MENU = re.compile(rb"(?m)^[ \t]*((?:%s)(?:[ \t]+(?:%s)){0,2})[ \t]*$" % (b"|".join(sorted(MENU)), b"|".join(sorted(MENU))))


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_symbols: float = 0.3
    bare_words: int = 20
    boiler_words: int = 25
    max_stutter: float = 0.3
    max_lost: float = 0.5


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "lost_chars")
_SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def repeated_words(w: W.Words, k: int = 3) -> np.ndarray:
    """Per document: words in k-word windows that occur at least twice in it."""
    h, ok = W.shingles(w, k)
    at = np.flatnonzero(ok)
    out = np.zeros(len(w.counts), np.int64)
    if not len(at):
        return out
    key = W.mix(h[at] ^ W.mix(w.doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(w.hash) + k, bool)
    for j in range(k):
        covered[at[twice] + j] = True
    s = _sums(covered[: len(w.hash)])
    return s[w.first[1:]] - s[w.first[:-1]]


def examine(bounds: np.ndarray, data: np.ndarray, rules: Rules) -> tuple[dict[str, np.ndarray], W.Words, np.ndarray]:
    """Counts for each document, its lines, and which lines fail."""
    w = W.scan(bounds, data, W.SPACED, lower=False)
    lines = W.scan(bounds, data, W.LINED, lower=False)
    n = len(bounds) - 1
    inner = _sums(W.SPACED[data] & ((data & 0xC0) != 0x80))
    chars = inner[w.end] - inner[w.start]
    symbols = _sums(SYMBOLS[data])
    lo, hi = np.searchsorted(w.start, lines.start), np.searchsorted(w.start, lines.end)
    words = hi - lo
    some = words > 0
    # lines equal to an earlier one of their document
    key = W.mix(lines.hash ^ W.mix(lines.doc.astype(np.uint64) + np.uint64(7)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    again &= some

    def at(s: np.ndarray) -> np.ndarray:
        return s[lines.end] - s[lines.start]

    doubled = np.zeros(len(data), bool)
    if len(data) > 1:
        doubled[1:] = (data[1:] == 0x21) & (data[:-1] == 0x21)
        doubled[bounds[:-1][bounds[:-1] < len(data)]] = False
    marks = at(_sums(MARKS[data]))
    noise = at(symbols) + at(_sums(doubled))
    lone = np.zeros(len(w.start), bool)
    short = (w.end - w.start) == 1
    lone[short] = np.isin(data[w.start[short]], list(b"|>"))
    alone = _sums(lone)
    stutter = np.zeros(len(w.hash), bool)
    stutter[1:] = w.hash[1:] == w.hash[:-1]
    if len(lo):
        stutter[lo[some]] = False
    stuttered = _sums(stutter)
    bad = some & (
        (noise >= rules.max_symbols * words)
        | ((words >= rules.bare_words) & (marks == 0))
        | (5 * (alone[hi] - alone[lo]) >= np.maximum(words, 1))
        | (stuttered[hi] - stuttered[lo] >= rules.max_stutter * words)
        | again
    )
    # short lines alone, each by itself, so that no match begins or ends by what its neighbours hold
    short_lines = np.flatnonzero(some & (words <= rules.boiler_words))
    raw = data.tobytes()
    parts = [raw[x:y] for x, y in zip(lines.start[short_lines].tolist(), lines.end[short_lines].tolist(), strict=True)]
    text = b"\n".join(parts).translate(W.LOWER_BYTES)
    found = [m.start() for m in _PHRASE.finditer(text)] + [m.start(1) for m in _MENU.finditer(text)]
    if found:
        begin = np.cumsum([0, *(len(x) + 1 for x in parts)])
        bad[short_lines[np.searchsorted(begin, found, "right") - 1]] = True
    cum = _sums(chars)
    line_chars = cum[hi] - cum[lo]
    doc = lines.doc

    def each(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, x, n).astype(np.int64)

    out = {
        "n_words": w.counts.astype(np.int64),
        "word_chars": cum[w.first[1:]] - cum[w.first[:-1]],
        "n_symbols": symbols[bounds[1:]] - symbols[bounds[:-1]],
        "n_dup_lines": each(again),
        "n_repeat_words": repeated_words(w),
        "n_bad_lines": each(bad),
        "lost_chars": each(line_chars * bad),
    }
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["n_words"] > 0) & (out["lost_chars"] <= rules.max_lost * out["word_chars"])
    return out, lines, bad


def _without(bounds: np.ndarray, data: np.ndarray, lines: W.Words, bad: np.ndarray) -> list[str]:
    """The texts without their bad lines, each with one break: that after it, or before it at the text's end."""
    keep = np.ones(len(data) + 1, bool)
    for s, e in zip(lines.start[bad], lines.end[bad], strict=True):
        keep[s:e] = False
    stop = bounds[lines.doc[bad] + 1]
    keep[lines.end[bad][lines.end[bad] < stop]] = False
    for lo, hi in zip(bounds[lines.doc[bad]][lines.end[bad] == stop], stop[lines.end[bad] == stop], strict=True):
        left = np.flatnonzero(keep[lo:hi])
        if len(left):  # what is left before a bad last line ends in a break
            keep[lo + left[-1]] = False
    gone = _sums(keep[: len(data)])
    at = gone[bounds]
    left = data[keep[: len(data)]].tobytes()
    return [left[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def _run(batches: Iterator[pa.RecordBatch], rules: Rules, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, bounds, data in W.groups(batch.column(0)):
            got, lines, bad = examine(bounds, data, rules)
            columns = [batch.column(i).slice(lo, hi - lo) for i in range(1, batch.num_columns)]
            names = batch.schema.names[1:]
            if texts:
                keep = pa.array(got["kept"])
                rows = [c.filter(keep) for c in [pa.array(_without(bounds, data, lines, bad), pa.string()), *columns]]
                yield pa.RecordBatch.from_arrays(rows, ["__text", *names])
            else:
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v) for v in got.values())], [*names, *got])


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """A row for each row of df: its id as doc_id, the counts, base_failed and kept."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).alias("doc_id"))
    return rows.mapInArrow(lambda b: W.settled(_run(b, rules, False)), f"doc_id {kind}, {_SCHEMA}")


def clean(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", rules: Rules = Rules()) -> DataFrame:
    """The kept documents with all columns of df, their bad lines removed.

    Where df has ``chars_col``, it becomes the length of the text that is left.
    """
    rest = [c for c in df.columns if c != text_col]
    rows = df.select(F.col(text_col).cast("string").alias("__text"), *(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(rest)))
    out = rows.mapInArrow(lambda b: W.settled(_run(b, rules, True)), rows.schema)
    back = {c: F.col(f"__{i}") for i, c in enumerate(rest)} | {text_col: F.col("__text")}
    if chars_col in rest:
        back[chars_col] = F.char_length("__text").cast(df.schema[chars_col].dataType)
    return out.select(*(back[c].alias(c) for c in df.columns))
