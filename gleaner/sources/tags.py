"""Tags of audio containers, found by walking their length fields; audio itself is never read.

ID3v2 (frames at the start of MP3 files), FLAC (metadata blocks with Vorbis comments) and MP4 (atoms below
``moov``). A file gives one row; a file that is damaged or unknown gives what was read before the damage, and an
``error``, so one file never stops the others.

``spark.read.format("tags").load(folder)`` after ``register(spark)``: the driver lists the folder, tasks open their
share of the files by seeking (any store that pyarrow knows). ``parsed`` reads contents that a table already holds.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = "kind string, tags map<string, array<string>>, has_art boolean, seconds double, lyrics string, synced string, error string"
ENDINGS = (".mp3", ".flac", ".m4a", ".mp4")
#: Text encodings of ID3 frames by their first byte. Fixed values.
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
#: Atoms that hold others on the way to the tags, and bytes of their own before these. Fixed values.
HOLDERS = {b"moov": 0, b"udta": 0, b"meta": 4, b"ilst": 0}
#: A length field that says more than this is damage, but for pictures, which are skipped.
MOST = 1 << 24


class Damaged(ValueError):
    pass


def _take(f: BinaryIO, n: int) -> bytes:
    if n > MOST:
        raise Damaged(f"a field of {n} bytes")
    got = f.read(n)
    if len(got) < n:
        raise Damaged("ends within a field")
    return got


def _seven(b: bytes) -> int:
    """A number of seven bits a byte."""
    out = 0
    for x in b:
        out = out << 7 | x & 127
    return out


def _texts(raw: bytes) -> list[str]:
    """The values of a text frame: an encoding byte, then texts between zeros."""
    if not raw or raw[0] >= len(ENCODINGS):
        raise Damaged("an unknown text encoding")
    return [x.removeprefix("﻿") for x in raw[1:].decode(ENCODINGS[raw[0]], "replace").rstrip("\0").split("\0")]


def _split(raw: bytes, encoding: int) -> tuple[str, bytes]:
    """The text up to a zero, and what follows."""
    wide = encoding in (1, 2)
    at = 0
    while at < len(raw) and (raw[at : at + 2] != b"\0\0" if wide else raw[at] != 0):
        at += 2 if wide else 1
    return raw[:at].decode(ENCODINGS[encoding], "replace").removeprefix("﻿"), raw[at + (2 if wide else 1) :]


def _stamp(ms: int) -> str:
    return f"[{ms // 60000:02d}:{ms % 60000 // 1000:02d}.{ms % 1000 // 10:02d}]"


def _id3(f: BinaryIO, out: dict) -> None:
    head = _take(f, 10)
    version, flags, left = head[3], head[5], _seven(head[6:10])
    if version not in (3, 4):
        raise Damaged(f"ID3 version {version}")
    if flags & 0x40:  # an extended header
        size = _take(f, 4)
        more = _seven(size) - 4 if version == 4 else int.from_bytes(size, "big")
        f.seek(more, io.SEEK_CUR)
        left -= 4 + more
    while left > 10:
        name, size, marks = struct.unpack(">4s4sH", _take(f, 10))
        if name[0] == 0:  # padding
            return
        n = _seven(size) if version == 4 else int.from_bytes(size, "big")
        left -= 10 + n
        if left < 0:
            raise Damaged("a frame beyond the tag")
        if name == b"APIC":
            out["has_art"] = True
            f.seek(n, io.SEEK_CUR)
            continue
        raw = _take(f, n)
        if (flags & 0x80 and version == 3) or marks & 2:
            raw = raw.replace(b"\xff\0", b"\xff")
        if version == 4 and marks & 1:
            raw = raw[4:]
        key = name.decode("latin-1")
        if key == "TXXX" and raw:
            values = _texts(raw)
            out["tags"].setdefault(f"TXXX:{values[0]}", []).extend(values[1:])
        elif key[0] == "T":
            out["tags"].setdefault(key, []).extend(_texts(raw))
        elif key == "USLT" and len(raw) > 4 and raw[0] < 4:
            _, rest = _split(raw[4:], raw[0])
            out["lyrics"] = out["lyrics"] or rest.decode(ENCODINGS[raw[0]], "replace").removeprefix("﻿").rstrip("\0")
        elif key == "SYLT" and len(raw) > 6 and raw[0] < 4 and raw[4] == 2:  # times in milliseconds
            _, rest = _split(raw[6:], raw[0])
            lines = []
            while rest:
                text, rest = _split(rest, raw[0])
                if len(rest) < 4:
                    raise Damaged("a line without its time")
                lines.append(_stamp(int.from_bytes(rest[:4], "big")) + text.strip("\n"))
                rest = rest[4:]
            out["synced"] = out["synced"] or "\n".join(lines)


def _comments(raw: bytes, out: dict) -> None:
    """Vorbis comments: lengths little-endian, KEY=value."""

    def number(at: int) -> int:
        if at + 4 > len(raw):
            raise Damaged("ends within a comment")
        return int.from_bytes(raw[at : at + 4], "little")

    at = 4 + number(0)
    count, at = number(at), at + 4
    for _ in range(count):
        n, at = number(at), at + 4
        if at + n > len(raw):
            raise Damaged("a comment beyond its block")
        key, _, value = raw[at : at + n].decode("utf-8", "replace").partition("=")
        out["tags"].setdefault(key.lower(), []).append(value)
        at += n


def _flac(f: BinaryIO, out: dict) -> None:
    _take(f, 4)
    last = False
    while not last:
        head = _take(f, 4)
        last, kind, n = bool(head[0] & 128), head[0] & 127, int.from_bytes(head[1:], "big")
        if kind == 0:
            info = int.from_bytes(_take(f, n)[10:18], "big")  # rate 20 bits, channels 3, depth 5, samples 36
            rate, samples = info >> 44, info & (1 << 36) - 1
            out["seconds"] = samples / rate if rate and samples else None
        elif kind == 4:
            _comments(_take(f, n), out)
        else:
            out["has_art"] = out["has_art"] or kind == 6
            f.seek(n, io.SEEK_CUR)
    found = out["tags"].get("lyrics") or out["tags"].get("unsyncedlyrics")
    out["lyrics"] = out["lyrics"] or (found[0] if found else None)


def _atoms(f: BinaryIO, end: int) -> Iterator[tuple[bytes, int]]:
    """(name, end) of the atoms up to a place; the file stands at an atom's content."""
    at = f.tell()
    while at + 8 <= end:
        f.seek(at)
        n, name = struct.unpack(">I4s", _take(f, 8))
        if n == 1:
            n = int.from_bytes(_take(f, 8), "big")
        stop = end if n == 0 else at + n
        if stop > end or stop <= at:
            raise Damaged("an atom beyond its holder")
        yield name, stop
        at = stop


def _mp4(f: BinaryIO, end: int, out: dict, inside: bytes = b"") -> None:
    for name, stop in _atoms(f, end):
        if name in HOLDERS:
            f.seek(HOLDERS[name], io.SEEK_CUR)
            _mp4(f, stop, out, name)
        elif name == b"mvhd":
            raw = _take(f, min(stop - f.tell(), 32))
            scale, ticks = struct.unpack(">IQ", raw[20:32]) if raw[0] == 1 else struct.unpack(">II", raw[12:20])
            out["seconds"] = ticks / scale if scale and ticks else None
        elif inside == b"ilst":
            key = name.decode("latin-1")
            for part, edge in _atoms(f, stop):
                if part != b"data":
                    continue
                if key == "covr":
                    out["has_art"] = True
                    continue
                raw = _take(f, edge - f.tell())
                kind, value = int.from_bytes(raw[:4], "big") & 0xFFFFFF, raw[8:]
                if key in ("trkn", "disk"):
                    text = str(int.from_bytes(value[2:4], "big"))
                else:
                    text = value.decode("utf-8", "replace") if kind == 1 else str(int.from_bytes(value, "big"))
                out["tags"].setdefault(key, []).append(text)
    found = out["tags"].get("©lyr")
    out["lyrics"] = out["lyrics"] or (found[0] if found else None)


def walk(f: BinaryIO, size: int) -> dict:
    """What a container says about itself: the columns of ``FIELDS``."""
    out = {"kind": None, "tags": {}, "has_art": False, "seconds": None, "lyrics": None, "synced": None, "error": None}
    try:
        head = f.read(8)
        f.seek(0)
        if head[:3] == b"ID3":
            out["kind"] = "id3"
            _id3(f, out)
        elif head[:4] == b"fLaC":
            out["kind"] = "flac"
            _flac(f, out)
        elif head[4:8] == b"ftyp":
            out["kind"] = "mp4"
            _mp4(f, size, out)
        else:
            out["error"] = "no container that is known"
    except (Damaged, struct.error, UnicodeDecodeError, OSError) as e:
        out["error"] = str(e) or type(e).__name__
    return out


def _frames(content: pd.Series) -> pd.DataFrame:
    none = {"kind": None, "tags": None, "has_art": None, "seconds": None, "lyrics": None, "synced": None, "error": "no content"}
    return pd.DataFrame([none if x is None else walk(io.BytesIO(bytes(x)), len(x)) for x in content], columns=list(none))


def parsed(content: Column | str) -> Column:
    """A struct of ``FIELDS`` for binary contents."""
    return F.pandas_udf(_frames, FIELDS)(content)


class _Share(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TagReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.share = options["path"], int(options.get("share", 500))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, folder = self._store()
        found = sorted(x.path for x in store.get_file_info(fs.FileSelector(folder, recursive=True)) if x.type == fs.FileType.File and x.path.lower().endswith(ENDINGS))
        return [_Share(found[i : i + self.share]) for i in range(0, len(found), self.share)] or [_Share([])]

    def read(self, partition: _Share) -> Iterator[tuple]:
        store, _ = self._store()
        for path in partition.paths:
            try:
                with store.open_input_file(path) as f:
                    out = walk(f, f.size())
            except OSError as e:
                out = {"kind": None, "tags": {}, "has_art": None, "seconds": None, "lyrics": None, "synced": None, "error": str(e)}
            yield (path, *out.values())


class Tags(DataSource):
    """``path``: a folder, read with all below it; ``share``: files of a task."""

    @classmethod
    def name(cls) -> str:
        return "tags"

    def schema(self) -> str:
        return f"path string, {FIELDS}"

    def reader(self, schema) -> DataSourceReader:
        return TagReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tags)
