"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs.

A piece of m symbols has m - 1 adjacent pairs. Their merge ranks are the leaves
of a segment tree whose nodes hold the smaller child, with ties to the left, so
the root is the leftmost pair of the lowest rank. A merge changes three leaves
(the pair itself goes, its two neighbours get new ranks), each in logarithmic
time, until the root is no mergeable pair. A piece of m symbols costs O(m log m),
however long it is. Short pieces are merged many at a time, their trees side by
side as rows of arrays; longer ones one by one, by the same rule.

Texts are cut into pieces as byte-level tokenizers cut them. Between two pieces
of visible characters a single space never changes how either side is cut, so a
text is also the sequence of its space-separated chunks. Distinct chunks and
pieces are encoded once while a bounded memo holds them; a text with more white
space around its chunks is cut as a whole. Special tokens of the vocabulary file are matched in texts first.

Defined cases: a null text is empty and has no tokens; any text of valid Unicode
decodes to itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words as W
from gleaner.llm.chunks import Memo, cut, spread

#: How byte-level tokenizers of this family cut text; a fixed pattern.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 62
FREE = np.int64(1 << 40)
MEMO = 150_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merge(symbols: list[int], ranks: dict[int, tuple[int, int]], shift: int = 20) -> list[int]:
    """Symbols after all merges. ranks: (left << shift | right) -> (rank, merged symbol)."""
    m = len(symbols)
    if m < 2:
        return symbols
    get = ranks.get
    if m == 2:
        hit = get(symbols[0] << shift | symbols[1])
        return [hit[1]] if hit else symbols
    size = 1
    while size < m - 1:
        size *= 2
    tree = [NONE] * (2 * size)  # rank << 32 | place
    for i in range(m - 1):
        hit = get(symbols[i] << shift | symbols[i + 1])
        if hit:
            tree[size + i] = hit[0] << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    sym = list(symbols)
    after = list(range(1, m + 1))
    before = list(range(-1, m - 1))
    while tree[1] != NONE:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        sym[i] = get(sym[i] << shift | sym[j])[1]
        sym[j] = -1
        k = after[i] = after[j]
        changed = [(j, NONE)]
        if k < m:
            before[k] = i
            hit = get(sym[i] << shift | sym[k])
            changed.append((i, hit[0] << 32 | i if hit else NONE))
        else:
            changed.append((i, NONE))
        p = before[i]
        if p >= 0:
            hit = get(sym[p] << shift | sym[i])
            changed.append((p, hit[0] << 32 | p if hit else NONE))
        for at, value in changed:
            node = size + at
            if node >= 2 * size or tree[node] == value:
                continue
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1
    return [s for s in sym if s >= 0]


class Ranks:
    """Merge ranks of symbol pairs as sorted arrays, and the symbol that each rank makes."""

    def __init__(self, ranks: dict[int, tuple[int, int]]):
        keys = np.fromiter(ranks, np.int64, len(ranks))
        order = np.argsort(keys)
        self.keys = keys[order]
        both = np.array(list(ranks.values()), np.int64).reshape(-1, 2)
        self.rank = both[order, 0]
        self.made = np.zeros(int(both[:, 0].max(initial=0)) + 1, np.int32)
        self.made[both[:, 0]] = both[:, 1]

    def leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """rank << 6 | place of each pair, FREE where it doesn't merge (or a symbol is -1)."""
        key = left.astype(np.int64) << 20 | right
        if not len(self.keys):
            return np.full(key.shape, FREE)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at] << 6 | place, FREE)


def merge_many(symbols: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """All merges of many short pieces in lockstep: (symbols left, how many of each piece).

    symbols: one row for each piece, padded with -1; its width less 1 is a power of two, 32 at most.
    Each row has a segment tree as in ``merge``; in a step every live row merges the pair at its root.
    """
    n, w = symbols.shape
    size = w - 1
    sym = np.full((n, w + 1), -1, np.int32)  # the last column stands for no symbol
    sym[:, :w] = symbols
    tree = np.full((n, 2 * size), FREE)
    tree[:, size:] = ranks.leaf(sym[:, : w - 1], sym[:, 1:w], np.arange(size))
    h = size // 2
    while h:
        tree[:, h : 2 * h] = np.minimum(tree[:, 2 * h : 4 * h : 2], tree[:, 2 * h + 1 : 4 * h : 2])
        h //= 2
    after = np.tile(np.arange(1, w + 2, dtype=np.int32), (n, 1))
    after[:, w] = w
    before = np.tile(np.arange(-1, w, dtype=np.int32), (n, 1))
    before[:, 0] = w
    live = np.flatnonzero(tree[:, 1] != FREE)
    while len(live):
        top = tree[live, 1]
        i = top & 63
        j = after[live, i]
        k = after[live, j]
        made = ranks.made[top >> 6]
        sym[live, i] = made
        sym[live, j] = -1
        after[live, i] = k
        before[live, k] = i
        p = before[live, i]
        # three leaves change: the merged pair's right neighbour goes, the pairs around the new symbol get new ranks
        gone = np.where(j < size, j, i)
        left = np.where(p < w, p, i)
        tree[live, size + gone] = FREE
        tree[live, size + left] = ranks.leaf(sym[live, p], made, p)
        tree[live, size + i] = ranks.leaf(made, sym[live, k], i)
        nodes = [size + gone, size + left, size + i]
        h = size
        while h > 1:
            nodes = [x >> 1 for x in nodes]
            for x in nodes:
                tree[live, x] = np.minimum(tree[live, 2 * x], tree[live, 2 * x + 1])
            h //= 2
        live = live[tree[live, 1] != FREE]
    kept = sym[:, :w] >= 0
    return sym[:, :w][kept], kept.sum(1)


class Codec:
    """Encoder and decoder of a byte-level vocabulary file (JSON of ``tokenizers``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a byte-level BPE file without normalizer and prefix space")
        vocab = model["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.first = [vocab.get(letters[b], -1) for b in range(256)]
        if min(self.first) < 0:
            raise ValueError("a byte has no symbol in the vocabulary")
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left] << 20 | vocab[right]] = (rank, vocab[left + right])
        self.pairs = Ranks(self.ranks)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        top = max(self.token) + 1
        self.bytes = [self.token.get(i, b"") for i in range(top)]
        self._cut = regex.compile(PIECES)
        longest = sorted(self.special, key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, longest))) if longest else None
        self._pieces = Memo(self._merged, MEMO)
        self._chunks = Memo(self._tokens, MEMO)

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, four bytes each."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        length = np.array([len(r) for r in raw])
        out = [b""] * len(raw)
        first = np.array(self.first, np.int32)
        low = 0
        for size in (1, 2, 4, 8, 16, 32):
            pick = np.flatnonzero((length > low) & (length <= size + 1))
            low = size + 1
            for a in range(0, len(pick), 1 << 15):
                rows = pick[a : a + (1 << 15)]
                n = length[rows]
                symbols = np.full((len(rows), size + 1), -1, np.int32)
                symbols[np.arange(size + 1) < n[:, None]] = first[np.frombuffer(b"".join([raw[i] for i in rows]), np.uint8)]
                ids, count = merge_many(symbols, self.pairs)
                flat, ends = ids.astype(np.int32).tobytes(), (np.cumsum(count) * 4).tolist()
                for i, x, y in zip(rows.tolist(), [0, *ends], ends, strict=False):
                    out[i] = flat[x:y]
        for i in np.flatnonzero(length > low):
            out[i] = np.array(merge([self.first[b] for b in raw[i]], self.ranks), np.int32).tobytes()
        return out

    def _tokens(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct strings, each cut into pieces on its own, four bytes each."""
        cuts = [self._cut.findall(c) for c in chunks]
        distinct = list(dict.fromkeys(chain.from_iterable(cuts)))
        known = dict(zip(distinct, self._pieces(distinct), strict=True))
        return [known[c[0]] if len(c) == 1 else b"".join([known[p] for p in c]) for c in cuts]

    def _whole(self, text: str) -> bytes:
        """Ids of a text that isn't the sequence of its chunks, special tokens first."""
        out, at = [], 0
        for m in self._special.finditer(text) if self._special else ():
            out += [*self._tokens([text[at : m.start()]]), np.int32(self.special[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*out, *self._tokens([text[at:]])])

    def encode_column(self, texts: pa.Array) -> Iterator[list[int]]:
        """Ids of each text; a null text is empty."""
        if texts.null_count:
            texts = texts.fill_null("")
        first, number, distinct = cut(texts)
        # a chunk at whose border white space meets the separator is cut together with its neighbours
        apart = np.fromiter((not c or c[0].isspace() or c[-1].isspace() for c in distinct), bool, len(distinct))
        whole = np.add.reduceat(apart[number], first[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        for mark in self.special:
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        each = spread(self._chunks([" " + c for c in distinct]), number)
        heads = first[:-1].tolist()
        opening = [distinct[i] for i in number[first[:-1]]]
        known = list(dict.fromkeys(opening))
        known = dict(zip(known, self._chunks(known), strict=True))
        for a, head in zip(heads, opening, strict=True):  # no space before the first chunk
            each[a] = known[head]
        for i, (a, b) in enumerate(zip(heads, first[1:].tolist(), strict=True)):
            ids = self._whole(texts[i].as_py()) if whole[i] else b"".join(each[a:b])
            yield np.frombuffer(ids, np.int32).tolist()

    def encode(self, text: str) -> list[int]:
        return next(self.encode_column(pa.array([text], pa.string())))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The file's codec, built once in each process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _rows(batches: Iterator[pa.RecordBatch], path: str, digests: bool) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for batch in batches:
        for lo, hi, *_ in W.groups(batch.column(0)):
            part = batch.slice(lo, hi - lo)
            n, sha, back, ids_out, texts = [], [], [], [], []
            for ids in c.encode_column(part.column(0)):
                decoded = c.decode(ids)
                n.append(len(ids))
                if digests:
                    sha.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                    back.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                else:
                    ids_out.append(np.array(ids, np.int32))
                    texts.append(decoded)
            more = [pa.array(sha, pa.string()), pa.array(back, pa.string())] if digests else [pa.array(ids_out, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(1, part.num_columns)), pa.array(n, pa.int64()), *more], [*part.schema.names[1:], "n_tokens", *names])


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and decoded for each row of df; ``path``: the vocabulary file."""
    return _apply(df, path, id_col, text_col, False)


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode, with SHA-256 of the comma-joined ids and of the decoded text instead of both."""
    return _apply(df, path, id_col, text_col, True)


def _apply(df: DataFrame, path: str, id_col: str, text_col: str, short: bool) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).alias("doc_id"))
    rest = "ids_sha256 string, decoded_sha256 string" if short else "ids array<int>, decoded string"
    return rows.mapInArrow(lambda b: W.settled(_rows(b, path, short)), f"doc_id {kind}, n_tokens long, {rest}")
