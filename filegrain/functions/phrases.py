"""Which of many phrases a text holds, all of them looked for in one reading.

A plain ``contains`` reads the text once for each phrase. Here four bytes of each phrase, its
rarest, are its key; numpy looks up the four bytes at every place of a batch of texts, and only
where a key stands is the whole phrase compared. What comes back are ordinals, exact: bytes of
UTF-8 are compared, as ``contains`` does.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import ship_package

WINDOW = 4
#: So many bytes are looked at in one go, whatever the length of the texts.
BLOCK = 1 << 18
_MIX = np.uint32(0x9E3779B1)  # odd: different windows have different keys
_COMMON = b" etaoinsrhldcumfpgwybvkxjqz"


def _keys(data: np.ndarray) -> np.ndarray:
    """A number for the window at each place."""
    return np.ndarray(max(0, len(data) - WINDOW + 1), np.uint32, np.ascontiguousarray(data), strides=(1,)) * _MIX


class Phrases:
    def __init__(self, phrases: Sequence[str]) -> None:
        self.words = [np.frombuffer(p.encode("utf-8", "surrogatepass"), np.uint8) for p in phrases]
        self.keyed: dict[int, list[tuple[int, int]]] = {}
        self.short: list[int] = []
        for i, word in enumerate(self.words):
            if len(word) < WINDOW:
                self.short.append(i)
                continue
            rarity = [_COMMON.find(b) if b in _COMMON else len(_COMMON) for b in word.tobytes()]
            at = max(range(len(word) - WINDOW + 1), key=lambda k: sum(rarity[k : k + WINDOW]))
            self.keyed.setdefault(int(_keys(word[at : at + WINDOW])[0]), []).append((i, at))
        self.known = np.zeros(1 << 16, bool)
        self.known[[key >> 16 for key in self.keyed]] = True

    def _places(self, data: np.ndarray, first: int):
        """(ordinal, places where the phrase may begin) of the keys that stand in one block."""
        span = data[first : first + BLOCK + WINDOW - 1]
        keys = _keys(span)
        hot = np.flatnonzero(self.known[keys >> np.uint32(16)])
        hot_keys = keys[hot]
        for key, some in self.keyed.items():
            at = hot[hot_keys == key]
            if len(at):
                for i, inside in some:
                    yield i, at + (first - inside)
        for i in self.short:
            word = self.words[i]
            if 0 < len(word) <= len(span):
                ends = min(BLOCK, len(span) - len(word) + 1)
                yield i, first + np.flatnonzero(np.logical_and.reduce([span[k : k + ends] == b for k, b in enumerate(word)]))

    def held(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """``row * number of phrases + ordinal``, ascending, of each text of ``data`` and phrase it holds."""
        found = [np.zeros(0, np.int64)]
        for first in range(0, len(data), BLOCK):
            some = []
            for i, starts in self._places(data, first):
                word = self.words[i]
                starts = starts[(starts >= offsets[0]) & (starts + len(word) <= offsets[-1])]
                starts = starts[(data[starts[:, None] + np.arange(len(word))] == word).all(axis=1)]
                row = np.searchsorted(offsets, starts, "right") - 1
                row = row[starts + len(word) <= offsets[row + 1]]
                some.append(np.unique(row) * len(self.words) + i)
            found += some
        return np.unique(np.concatenate(found))

    def found(self, texts: pa.Array) -> pa.Array:
        """Ordinals of the phrases in each text, ascending; none for a text that is null."""
        there = np.flatnonzero(np.array(texts.is_valid()))
        texts = texts.fill_null("").cast(pa.large_binary())
        _, ends, data = texts.buffers()
        offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        everywhere = [there * len(self.words) + i for i in self.short if not len(self.words[i])]
        held = np.sort(np.concatenate([self.held(data[offsets[0] :], offsets - offsets[0]), *everywhere]))
        rows = held // max(len(self.words), 1)
        return pa.ListArray.from_arrays(
            pa.array(np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)), pa.array((held % max(len(self.words), 1)).astype(np.int32))
        )


def phrases_in(text: Column, phrases: Sequence[str]) -> Column:
    """Ordinals of the phrases (lower case) that the lower-cased text contains, ascending."""
    ship_package()
    search = Phrases(phrases)

    @F.arrow_udf("array<int>")
    def find(texts: pa.Array) -> pa.Array:
        return search.found(texts)

    return find(F.lower(text))
