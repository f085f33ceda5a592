"""Texts as sequences of chunks between single separators, each distinct chunk handled once.

A column of texts is split and dictionary-encoded by Arrow's own code; only the
distinct chunks of a group become Python strings. What is made of a chunk is held
in a memo of two generations, so frequent chunks stay and memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Memo:
    """Entries of strings, made once for each string while it is held.

    ``make`` gives the entries of a list of distinct strings. At most ``2 * limit``
    entries are held, none of a string longer than ``longest``.
    """

    def __init__(self, make: Callable[[list[str]], list], limit: int, longest: int = 64):
        self.make, self.limit, self.longest = make, limit, longest
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def __call__(self, keys: list[str]) -> list:
        """The entry of each key (keys are distinct)."""
        out = list(map(self.young.get, keys))
        lack = [i for i, x in enumerate(out) if x is None]
        if not lack:
            return out
        if len(self.young) + len(lack) > self.limit:
            self.old, self.young = self.young, {}
        get = self.old.get
        new = []
        for i in lack:
            out[i] = get(keys[i])
            if out[i] is None:
                new.append(i)
        for i, entry in zip(new, self.make([keys[i] for i in new]) if new else (), strict=True):
            out[i] = entry
        self.young.update((keys[i], out[i]) for i in lack if len(keys[i]) <= self.longest)
        return out


def cut(texts: pa.Array, separator: str = " ") -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(first chunk of each text and one more, number of each chunk's string, the distinct strings).

    A text has one chunk more than separators; an empty or null text has one empty chunk.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    parts = pc.split_pattern(texts, separator)
    first = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.slice(first[0], first[-1] - first[0]).dictionary_encode() if len(texts) else pa.array([], pa.string()).dictionary_encode()
    return first - first[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def spread(entries: list, number: np.ndarray) -> list:
    """The entry of each chunk."""
    held = np.empty(len(entries), object)
    held[:] = entries
    return held[number].tolist()
