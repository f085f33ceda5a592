"""Chat formatting at token level.

A turn becomes  START role "\\n" text END "\\n"  in token ids. Role and text are
encoded on their own (so no token spans a border), START and END are reserved ids
beyond the vocabulary, spliced in and never produced from text. Rendered as text,
START and END are ``<|im_start|>`` and ``<|im_end|>``. So that rendering stays
unambiguous, ``<|`` in a role or text is escaped: between ``<`` and ``|``, one
backslash is added to those that are there; decoding takes one away. In roles,
line feeds and backslashes are escaped too.

The loss mask covers the ids of assistants' texts and nothing else. Turns carry
their lengths; prefix sums over a conversation give each turn's first position and
the run of positions under the mask.

Encoding is a narrow step over turns. Turns then meet by conversation, sorted,
and are read as a stream: a conversation of any number of turns takes constant
memory, and the output has a row for each turn.

Defined cases: null roles and texts are empty; turns come in the order of turn
(nulls first), then of their ids, so equal rows stay, next to each other; a null
conversation id is a conversation; a table without rows gives none; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


class Template:
    """A vocabulary file of ``tokenizers`` with two reserved ids after its last."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.lib.encode_special_tokens = True
        self.start = self.lib.get_vocab_size(with_added_tokens=True)
        self.end = self.start + 1
        (self.line,) = self.lib.encode("\n", add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids, skip_special_tokens=False)

    def segments(self, turns: list[list[int]]) -> list[tuple[str, str]]:
        """Role and text of each turn's ids, as they stand between the reserved ids; each decoded once."""
        parts = []
        for ids in turns:
            if ids[0] != self.start or ids[-2:] != [self.end, self.line]:
                raise ValueError("no turn")
            cut = ids.index(self.line)
            parts += [ids[1:cut], ids[cut + 1 : -2]]
        said = self.lib.decode_batch(parts, skip_special_tokens=False)
        return list(zip(said[::2], said[1::2], strict=True))


_templates: dict[str, Template] = {}


def template(path: str) -> Template:
    if path not in _templates:
        _templates[path] = Template(path)
    return _templates[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = template(path)
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            roles = [r or "" for r in part.column(2).to_pylist()]
            kinds = list(dict.fromkeys(roles))  # few in a batch
            known = dict(zip(kinds, t.encode([escape_role(r) for r in kinds]), strict=True))
            heads = [known[r] for r in roles]
            bodies = t.encode([escape(x or "") for x in part.column(3).to_pylist()])
            blobs = [np.array([t.start, *h, t.line, *b, t.end, t.line], "<i4").tobytes() for h, b in zip(heads, bodies, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(blobs, pa.binary()), pa.array([len(h) for h in heads], pa.int32()), pa.array([r == "assistant" for r in roles])],
                ["conv_id", "turn", "blob", "role_ids", "learn"],
            )


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns -> ids with positions; carries sums from batch to batch."""
    key, place, turns = object(), 0, 0
    for batch in batches:
        convs = batch.column(0).to_pylist()
        blobs = batch.column(2).to_pylist()
        size = np.array([len(b) // 4 for b in blobs], np.int64)
        role = np.array(batch.column(3).to_pylist(), np.int64)
        learn = np.array(batch.column(4).to_pylist(), bool)
        n = len(convs)
        new = np.array([i == 0 and convs[0] != key or i > 0 and convs[i] != convs[i - 1] for i in range(n)], bool)
        sums = np.concatenate(([0], np.cumsum(size)))[:-1]  # ids before each turn, in the batch
        group = np.cumsum(new)
        heads = np.concatenate(([-1], np.flatnonzero(new)))[group]
        first = sums - np.where(heads >= 0, sums[heads], -place)
        pos = np.arange(n) - np.where(heads >= 0, heads, -turns)
        if n:
            key, place, turns = convs[-1], int(first[-1] + size[-1]), int(pos[-1]) + 1
        low = first + role + 2
        high = first + size - 2
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(np.frombuffer(b"".join(blobs), "<i4"), pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(pos), ids, pa.array(first), pa.array(low, mask=~learn), pa.array(high, mask=~learn)],
            ["conv_id", "pos", "ids", "first_id", "loss_from", "loss_to"],
        )


def format_turns(df: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each turn: conv_id, pos, ids, first_id and the run of positions under the loss mask.

    Rows of a conversation follow each other in one partition, in order.
    """
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    encoded = rows.mapInArrow(lambda b: _encode(b, path), f"conv_id {kinds[0]}, turn {kinds[1]}, blob binary, role_ids int, learn boolean")
    met = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "blob")
    return met.mapInArrow(_assemble, f"conv_id {kinds[0]}, pos long, ids array<int>, first_id long, loss_from long, loss_to long")


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = template(path)
    done: list[tuple] = []
    open_: list | None = None  # id, turns, sha of turns, loss chars, sha of loss, chars

    def row(x: list) -> tuple:
        return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]

    def full() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        kind = batch.schema.field(0).type
        turns = batch.column(2).to_pylist()
        said = t.segments(turns)
        for conv, ids, first, low, high, (role, text) in zip(batch.column(0).to_pylist(), turns, *(batch.column(i).to_pylist() for i in (3, 4, 5)), said, strict=True):
            if open_ is None or first == 0:
                if open_ is not None:
                    done.append(row(open_))
                open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            plain = unescape(text)
            open_[1] += 1
            open_[2].update(f"{unescape_role(role)}\n{plain}\n".encode())
            if low is not None:
                # the mask is read as it is; where it covers the text's ids their decoding is at hand
                whole = (low - first, high - first) == (ids.index(t.line) + 1, len(ids) - 2)
                learned = plain if whole else unescape(t.decode(ids[low - first : high - first]))
                open_[3] += len(learned)
                open_[4].update(learned.encode())
            open_[5] += len(START) + len(role) + 1 + len(text) + len(END) + 1
        if len(done) >= 4096:
            yield full()
    if open_ is not None:
        done.append(row(open_))
    if done:
        yield full()


def digests(turns: DataFrame, path: str) -> DataFrame:
    """What ``format_turns`` says, read back from its ids and mask: a row for each conversation."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(lambda b: _digest(b, path), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
