"""Matching-block similarity of texts, with bounds that leave out most pairs before any comparison.

The ratio is 2 * M / (characters of both), where M adds up the longest common block, then those left and
right of it, and so on; of equally long blocks the first in the first text counts, then the first in the
second. In second texts of 200 characters and more, characters that make up over one hundredth of it begin no block.

M is never above the shorter text's length, nor above the characters that both have in common. Both
bounds are Column expressions; only pairs whose bound passes go to the comparison, the others are null there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"


def length_bound(a: Column, b: Column) -> Column:
    """Upper bound of the ratio by lengths; 1 for two empty texts."""
    whole = F.char_length(a) + F.char_length(b)
    return F.when(whole == 0, 1.0).otherwise(2.0 * F.least(F.char_length(a), F.char_length(b)) / whole)


def count_bound(a: Column, b: Column, alphabet: str = ALPHABET) -> Column:
    """Upper bound of the ratio by characters in common, for texts of this alphabet; other characters count as common as they may be."""

    def held(x: Column, ch: Column) -> Column:
        return F.char_length(x) - F.char_length(F.replace(x, ch))

    letters = F.split(F.lit(alphabet), "")
    common = F.aggregate(letters, F.lit(0), lambda n, ch: n + F.least(held(a, ch), held(b, ch)))
    others = F.least(*(F.char_length(F.translate(x, alphabet, "")) for x in (a, b)))
    whole = F.char_length(a) + F.char_length(b)
    return F.when(whole == 0, 1.0).otherwise(2.0 * (common + others) / whole)


def _codes(x: str) -> np.ndarray:
    return np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """Characters in matching blocks of two arrays."""
    if not len(a) or not len(b):
        return 0
    # runs[i, j]: characters that agree up to a[i], b[j]; a diagonal's runs end where it disagrees
    equal = a[:, None] == b[None, :]
    usable = np.ones(len(b), bool)
    if len(b) >= 200:
        _, at, count = np.unique(b, return_inverse=True, return_counts=True)
        usable = (count <= len(b) // 100 + 1)[at]
    runs = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a)):
        runs[i + 1, 1:] = np.where(equal[i] & usable, runs[i, :-1] + 1, 0)
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo == ahi or blo == bhi:
            continue
        # a run that began before the window counts from its edge
        part = np.minimum(runs[alo + 1 : ahi + 1, blo + 1 : bhi + 1], np.minimum(np.arange(1, ahi - alo + 1)[:, None], np.arange(1, bhi - blo + 1)[None, :]))
        size = int(part.max())
        if size:
            i, j = (x - size + 1 for x in _first_start(part, size))
            i, j = alo + i, blo + j
        else:
            i, j = alo, blo
        # characters that begin no block still lengthen one, also an empty one at the window's start
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if not size:
            continue
        total += size
        todo += [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
    return total


def _first_start(part: np.ndarray, size: int) -> tuple[int, int]:
    """The end of the longest run that begins first in a, then in b; runs are equally long, so the first end."""
    flat = int(np.argmax(part == size))
    return divmod(flat, part.shape[1])


def ratio(a: str, b: str) -> float:
    whole = len(a) + len(b)
    if not whole:
        return 1.0
    if a == b:
        return 1.0
    return 2.0 * matched(_codes(a), _codes(b)) / whole


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def with_ratio_above(df: DataFrame, a: str, b: str, least: float, name: str, alphabet: str = ALPHABET) -> DataFrame:
    """name: whether the ratio of two columns is above ``least``; pairs that a bound decides aren't compared. Null if a text is."""
    x, y = F.col(a), F.col(b)
    may = df.withColumn("__may", (x != y) & (length_bound(x, y) > least)).withColumn("__may", F.when(F.col("__may"), count_bound(x, y, alphabet) > least))
    told = may.withColumn("__ratio", _ratio(F.when(F.col("__may"), x), F.when(F.col("__may"), y)))
    verdict = F.when(x.isNull() | y.isNull(), None).when(x == y, F.lit(1.0 > least)).otherwise(F.coalesce(F.col("__ratio") > least, F.lit(False)))
    return told.withColumn(name, verdict).drop("__may", "__ratio")


def _best(words: list[str], others: list[str], least: float) -> bool:
    for x in words:
        for y in others:
            if x == y:
                return True
            whole = len(x) + len(y)
            if 2.0 * min(len(x), len(y)) >= least * whole and ratio(x, y) >= least:
                return True
    return False


@F.pandas_udf(T.BooleanType())
def _pair_alike(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _best(list(x), list(y), t) for x, y, t in zip(a, b, least, strict=True)], dtype="object")


def with_words_alike(df: DataFrame, a: str, b: str, least: float, needed: str, name: str) -> DataFrame:
    """name: whether a word of one list and a word of the other are equal or have at least this ratio, where that is ``needed``; shared words need no comparison."""
    shared = df.withColumn("__shared", F.coalesce(F.arrays_overlap(a, b), F.lit(False)))
    asked = F.col(needed) & ~F.col("__shared")
    told = shared.withColumn("__found", _pair_alike(F.when(asked, F.col(a)), F.when(asked, F.col(b)), F.lit(least)))
    return told.withColumn(name, F.col("__shared") | F.coalesce("__found", F.lit(False))).drop("__shared", "__found")
