"""Ids of texts by way of their distinct parts, all by array arithmetic: parts are cut, hashed and looked up for many
texts at once, and only parts that were not seen before are encoded."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np

from textpulse.llm.shingles import mixed, powers

#: Different parts that a Python worker remembers, about 30 bytes each.
PARTS = 4_000_000
#: Stands between texts; texts that hold it themselves are encoded alone.
BORDER = ""


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0: other, 1: letter or digit, 2: space, 3: other white space or apostrophe; by code point."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for i in range(len(out)):
        c = chr(i)
        out[i] = 1 if c.isalnum() else 3 if c.isspace() else 0
    out[ord("'")], out[ord(" ")] = 3, 2
    return out


def cuts(points: np.ndarray) -> np.ndarray:
    """Begins of the parts of a text of code points that begins with BORDER.

    A part is a word (letters and digits) with the space before it, or what stands between words; white space and
    apostrophes take the word after them along. BORDER is a part of its own.
    """
    kind = _classes()[points]
    word = kind == 1
    begin = np.zeros(len(points), dtype=bool)
    begin[0] = True
    begin[1:] |= word[:-1] & ~word[1:]
    first = np.flatnonzero(word[1:] & ~word[:-1]) + 1  # of words
    before = kind[first - 1]
    begin[first[before == 0]] = True
    begin[first[before == 2] - 1] = True
    border = np.flatnonzero(points == ord(BORDER))
    begin[border] = True
    begin[border[border + 1 < len(points)] + 1] = True
    return np.flatnonzero(begin)


class PartTable:
    """Ids by part hash; ``encode`` gives the ids of many parts."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], end_id: int, limit: int = PARTS):
        self.encode, self.end_id, self.limit = encode, end_id, limit
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.empty(0, dtype=np.uint64)
        self.starts, self.sizes = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.pool = np.empty(0, dtype=np.int32)

    def _learn(self, hashes: np.ndarray, parts: list[str]) -> None:
        """Add new parts; ``hashes`` are ascending and not in the table."""
        if len(self.hashes) + len(hashes) > self.limit:
            self._clear()
        found = [np.array([self.end_id], dtype=np.int32)] * len(parts)
        real = [i for i, p in enumerate(parts) if p != BORDER]
        for i, ids in zip(real, self.encode([parts[i] for i in real]), strict=True):
            found[i] = ids
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        starts = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate([self.pool, *found])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts, self.sizes = np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id after it, and where each text's ids end."""
        joined = BORDER + BORDER.join(texts) + BORDER
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        begin = cuts(points)[1:]  # without the border in front
        end = np.append(begin[1:], len(points))
        power, inverse = powers(len(points) + 1)
        prefix = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=prefix[1:])
        every, one, back = np.unique(mixed((prefix[end] - prefix[begin]) * inverse[begin]), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, every)
        at[at == len(self.hashes)] = 0
        new = self.hashes[at] != every if len(self.hashes) else np.ones(len(every), dtype=bool)
        if new.any():
            full = len(self.hashes) + int(new.sum()) > self.limit
            unseen = np.flatnonzero(new) if not full else np.arange(len(every))
            self._learn(every[unseen], [joined[begin[i] : end[i]] for i in one[unseen]])
            at = np.searchsorted(self.hashes, every)
        starts, sizes = self.starts[at][back], self.sizes[at][back]
        ends = np.cumsum(sizes)
        values = self.pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return values, ends[np.flatnonzero(points[begin] == ord(BORDER))]
