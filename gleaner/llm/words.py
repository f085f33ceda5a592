"""Vectorised word scanning of Arrow string columns.

A column of texts is read as one byte buffer: words, lines and their 64-bit
hashes come from array operations, never from a Python loop over words. UTF-8
needs no decoding, because every separator used here is one ASCII byte.

A word hash is a polynomial over a table of random 64-bit values, one for each
byte, finished by a mixing step; upper-case A-Z may share the values of a-z.
Nulls are empty texts. A group of documents is scanned in blocks, so memory
follows the group (2 MB by default) or the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
GROUP = 1 << 21
_rng = np.random.Generator(np.random.PCG64(20240607))
_RAW = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Bytes of words: all but space and \t \n \v \f \r.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words of letters and digits: 0-9, a-z (A-Z too, to be lower-cased) and all above ASCII.
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_lo : _hi + 1] = True
#: Bytes of lines.
LINED = np.ones(256, bool)
LINED[0x0A] = False

_LOWERED = _RAW.copy()
_LOWERED[0x41:0x5B] = _RAW[0x61:0x7B]
LOWER_BYTES = bytes(x + 32 if 0x41 <= x <= 0x5A else x for x in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(BLOCK * 2, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POW: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW:
        _POW.extend((_powers(_BASE), _powers(_BASE_INV)))
    if n > len(_POW[0]):  # one word longer than a block
        return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64)))) for b in (_BASE, _BASE_INV))
    return _POW[0], _POW[1]


@dataclass
class Words:
    """Words (or lines) of a group of documents, in order.

    first: index of each document's first word, one more at the end.
    start, end: byte places in ``data``. doc: the document of each word.
    """

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.string()), False
    n = len(column)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if n == 0 or offsets is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def groups(column: pa.Array, size: int = GROUP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bounds, bytes) of runs of rows of about ``size`` bytes."""
    at, data = buffers(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        hi = min(hi, n, lo + 20_000)
        yield lo, hi, at[lo : hi + 1] - at[lo], data[at[lo] : at[hi]]
        lo = hi


def scan(bounds: np.ndarray, data: np.ndarray, inside: np.ndarray, lower: bool) -> Words:
    """The runs of bytes that ``inside`` marks, cut at the documents' bounds."""
    values = _LOWERED if lower else _RAW
    n = len(data)
    heads = np.zeros(n + 1, bool)
    heads[bounds] = True
    starts, ends, hashes = [], [], []
    lo = 0
    while lo < n:
        hi = min(n, lo + BLOCK)
        while hi < n:  # up to a separator or a document's end
            part = data[hi : hi + 4096]
            stop = np.flatnonzero(~inside[part] | heads[hi : hi + len(part)])
            if len(stop):
                hi += int(stop[0])
                break
            hi = min(n, hi + len(part))
        part = data[lo:hi]
        word = inside[part]
        head = heads[lo:hi]
        opens = word.copy()
        opens[1:] &= ~word[:-1] | head[1:]
        start = np.flatnonzero(opens)
        closes = word.copy()
        closes[:-1] &= ~word[1:] | head[1:]
        end = np.flatnonzero(closes) + 1
        if len(start):
            up, down = _pow(hi - lo + 1)
            sums = np.empty(hi - lo + 1, np.uint64)
            sums[0] = 0
            np.cumsum(values[part] * up[: hi - lo], out=sums[1:])
            h = (sums[end] - sums[start]) * down[start]
            hashes.append(mix(h + (end - start).astype(np.uint64)))
            starts.append(start + lo)
            ends.append(end + lo)
        lo = hi
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    return Words(data, bounds, start, np.concatenate(ends) if ends else none, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.searchsorted(start, bounds))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether all are of one document."""
    n = len(words.hash)
    out = np.zeros(n, np.uint64)
    ok = np.zeros(n, bool)
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h = mix(h + words.hash[j : n - k + 1 + j] * np.uint64(2 * j + 3))
        out[: n - k + 1] = h
    room = np.repeat(words.first[1:], words.counts) - np.arange(n)
    ok[:] = room >= k
    return out, ok


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at the end memory that is free goes back to the system, as the process lives on for other tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it has
        pass
