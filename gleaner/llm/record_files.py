"""Token ids in files of length-delimited, checksummed records with an offset index.

File (``part-00000.rec``): 8 bytes ``GLREC1`` + width (``2`` or ``4``) + ``\\n``; then
for each document

    length   8 bytes, little-endian: bytes of the payload
    check    4 bytes: masked CRC-32 of the 8 length bytes
    payload  1 byte (1: the id is null), 8 bytes signed id, ids of ``width`` bytes each
    check    4 bytes: masked CRC-32 of the payload

Index (``part-00000.idx``): for each record its byte place and the number of ids
before it in the file, 8 bytes each, so any record is read with one seek. A masked
checksum is rotated right by 15 bits and has 0xA282EAD8 added, so a checksum of
bytes that hold checksums keeps its strength.

Documents are range-partitioned by id and sorted in each partition; file order is
id order. Every task writes under a name of its own and renames when it is done,
so a task that runs again replaces a file by an equal one.

Encoding uses the ``tokenizers`` library. Where the vocabulary file drops white
space and case, a text is the sequence of its chunks between spaces and line feeds;
the library encodes each distinct chunk once while a bounded memo keeps it. Other
files get whole texts. The end id closes each document.

Defined cases: a null text is empty and is one record of the end id alone; null
ids come first; equal ids follow each other in the order of their texts' hashes;
an empty table writes no files; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import words as W
from gleaner.llm.chunks import Memo, cut, spread

MAGIC = b"GLREC1"
MEMO = 400_000
#: How the vocabulary files meant here cut normalized text; a fixed pattern.
WORD_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MANIFEST = "part int, path string, first_id long, n_records long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Writes one record file and its index; ``close`` makes both appear."""

    def __init__(self, uri: str, width: int):
        self.fs, self.path = _place(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{self.own}.rec")
        self.out.write(MAGIC + b"%d\n" % width)
        self.at, self.tokens, self.width = 8, 0, width
        self.index: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        payload = struct.pack("<Bq", doc_id is None, doc_id or 0) + ids
        head = struct.pack("<Q", len(payload))
        self.index.append((self.at, self.tokens))
        self.out.write(b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload)))))
        self.at += len(payload) + 16
        self.tokens += len(ids) // self.width

    def close(self) -> None:
        self.out.close()
        with self.fs.open_output_stream(f"{self.own}.idx") as f:
            f.write(np.array(self.index, "<u8").tobytes())
        for kind in ("rec", "idx"):
            self.fs.move(f"{self.own}.{kind}", f"{self.path}.{kind}")


class Reader:
    """Records of one file, in any order."""

    def __init__(self, uri: str):
        self.fs, self.path = _place(uri)
        with self.fs.open_input_stream(f"{self.path}.idx") as f:
            self.index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
        self.file = self.fs.open_input_file(f"{self.path}.rec")
        head = self.file.read_at(8, 0)
        if head[:6] != MAGIC:
            raise ValueError(f"{uri}: no record file")
        self.width = int(head[6:7])

    def __len__(self) -> int:
        return len(self.index)

    def _record(self, data: bytes, at: int) -> tuple[int | None, bytes, int]:
        head = data[at : at + 8]
        (n,) = struct.unpack("<Q", head)
        if struct.unpack_from("<I", data, at + 8)[0] != masked(head):
            raise ValueError(f"{self.path}: a length is damaged")
        payload = data[at + 12 : at + 12 + n]
        if len(payload) != n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
            raise ValueError(f"{self.path}: a record is damaged")
        null, doc_id = struct.unpack_from("<Bq", payload)
        return None if null else doc_id, payload[9:], at + 16 + n

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, f"<u{self.width}")

    def read(self, i: int) -> tuple[int | None, np.ndarray]:
        at = int(self.index[i, 0])
        end = int(self.index[i + 1, 0]) if i + 1 < len(self) else self.file.size()
        doc_id, raw, _ = self._record(self.file.read_at(end - at, at), 0)
        return doc_id, self.ids(raw)

    def scan(self, block: int = 1 << 22) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, ids before it, ids) of all records in order, reading about ``block`` bytes at a time."""
        places = self.index[:, 0].tolist() + [self.file.size()]
        lo = 0
        while lo < len(self):
            hi = max(lo + 1, int(np.searchsorted(self.index[:, 0], places[lo] + block, "right")) - 1)
            data = self.file.read_at(places[hi] - places[lo], places[lo])
            at = 0
            for i in range(lo, hi):
                doc_id, raw, at = self._record(data, at)
                yield doc_id, int(self.index[i, 1]), self.ids(raw)
            lo = hi


class Encoder:
    """The library's encoder; distinct chunks between spaces and line feeds are encoded once.

    Chunks may be encoded apart, and in lower case, where the file's normalizer makes
    white space one space and lowers case, and its pre-tokenizer drops white space. Any
    other file, and a text with a special token (in any case), goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.width = 2 if self.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.apart = _by_chunks(spec)
        self.special = [t["content"].lower() for t in spec["added_tokens"]]
        closing = spec["model"].get("end_of_word_suffix")
        self.closes = np.zeros(1 << 8 * self.width if self.width == 2 else self.lib.get_vocab_size(with_added_tokens=True), bool)
        if closing:
            self.closes[[i for t, i in spec["model"]["vocab"].items() if t.endswith(closing)]] = True
        self.memo = Memo(self._chunks, MEMO)

    def _library(self, texts: list[str]) -> list[bytes]:
        kind = f"<u{self.width}"
        out = []
        for lo in range(0, len(texts), 4096):
            out += [np.array(x.ids, kind).tobytes() for x in self.lib.encode_batch(texts[lo : lo + 4096], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of chunks of letters: many in one text, cut after ids that close a word."""
        out = []
        for lo in range(0, len(words), 1024):
            part = words[lo : lo + 1024]
            (got,) = self.lib.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(got.ids, f"<u{self.width}")
            ends = (np.flatnonzero(self.closes[ids]) + 1) * self.width
            if len(ends) == len(part):  # each has one close at least, so each has just one
                raw, ends = ids.tobytes(), ends.tolist()
                out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            else:  # a letter that normalization takes apart
                out += self._library(part)
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        # a mark after a letter that stays one letter is a piece of its own: the word before it is encoded once
        stems = {c: c[:-1] for c in chunks if len(c) > 1 and c[-1] in ".," and c[-2] < "\u0250" and c[-2] != "\u0130" and c[-2].isalpha()}
        words = {*stems.values(), ".", ",", *(c for c in chunks if c not in stems)}
        letters = [w for w in words if w.isalpha()]
        others = list(words.difference(letters))
        known = dict(zip(letters, self._words(letters), strict=True))
        known.update(zip(others, self._library(others), strict=True))
        return [known[stems[c]] + known[c[-1]] if c in stems else known[c] for c in chunks]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text; a null text is empty."""
        if texts.null_count:
            texts = texts.fill_null("")
        if not self.apart:
            return self._library(texts.to_pylist())
        low = pc.ascii_lower(texts)
        first, number, distinct = cut(pc.replace_substring(low, "\n", " "))
        each = spread(self.memo(distinct), number)
        bounds = first.tolist()
        out = [b"".join(each[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for mark in self.special:
            for i in np.flatnonzero(pc.match_substring(low, mark).to_numpy(zero_copy_only=False)):
                (out[i],) = self._library([texts[int(i)].as_py()])
        return out


def _by_chunks(spec: dict) -> bool:
    """Whether a vocabulary file drops white space and case, and joins nothing across white space."""
    parts = (spec["normalizer"] or {}).get("normalizers", [])
    pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    spaced = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    kinds = [p["type"] for p in parts]
    return (
        kinds == ["NFC", "Replace", "Lowercase"] and parts[1] == spaced
        and pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and bool(pre[0].get("invert"))
        and pre[0]["pattern"].get("Regex") == WORD_CUT
        and pre[1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    )


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int, out: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    end = np.array([end_id], f"<u{enc.width}").tobytes()
    part = TaskContext.get().partitionId()
    uri, writer, first = f"{out}/part-{part:05d}", None, None
    for batch in batches:
        for lo, hi, *_ in W.groups(batch.column(1)):
            ids = batch.column(0).slice(lo, hi - lo).to_pylist()
            if writer is None:
                writer, first = Writer(uri, enc.width), ids[0]
            for doc_id, raw in zip(ids, enc.encode(batch.column(1).slice(lo, hi - lo)), strict=True):
                writer.add(doc_id, raw + end)
    if writer is not None:
        writer.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([uri]), pa.array([first], pa.int64()), pa.array([len(writer.index)], pa.int64()), pa.array([writer.tokens], pa.int64())],
            ["part", "path", "first_id", "n_records", "n_tokens"],
        )


def write(df: DataFrame, out: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Writes all rows below ``out``, a folder that all machines share; returns the manifest.

    The manifest has a row for each file and is checkpointed, so files are written once.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    return rows.mapInArrow(lambda b: _write(b, tokenizer, end_id, out), MANIFEST).checkpoint()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def full(rows: list) -> pa.RecordBatch:
        doc, start, n, crc = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    for batch in batches:
        for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            for doc_id, at, ids in Reader(uri).scan():
                rows.append((doc_id, before + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if len(rows) == 8192:
                    yield full(rows)
                    rows = []
            if rows:
                yield full(rows)


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record, from the files alone."""
    files = manifest.select("path", "part", F.expr("coalesce(sum(n_tokens) over (order by part rows between unbounded preceding and 1 preceding), 0L)").alias("before"))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartitionByRange(parts, "part").select("path", "before").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder in the cluster's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
