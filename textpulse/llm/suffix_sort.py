"""Sorting suffixes by hash comparison.

Two suffixes are compared by their longest common extension, found by binary search over prefix polynomial hashes,
and the byte after it. Many suffixes are sorted at once: a bottom-up mergesort in which all elements of a level look
for their places in their sibling runs together. Neighbours' extensions are checked byte by byte.
"""

from __future__ import annotations

import numpy as np

from textpulse.llm.shingles import powers, prefix_hashes


class Suffixes:
    """Suffixes of ``raw`` from the places ``at`` over ``length`` bytes; ``step`` -1 reads them backwards."""

    def __init__(self, raw: np.ndarray, hashes: np.ndarray, at: np.ndarray, length: np.ndarray, step: int = 1):
        self.raw, self.hashes, self.at, self.length, self.step = raw, hashes, at, length, step
        self.unshift = powers(len(hashes))[1]

    def _head(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hashes of the first ``n`` bytes of the suffixes ``i``."""
        begin = self.at[i] if self.step > 0 else self.at[i] - n
        return (self.hashes[begin + n] - self.hashes[begin]) * self.unshift[begin]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension of each pair."""
        low = np.zeros(len(i), dtype=np.int64)
        high = np.minimum(self.length[i], self.length[j])
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) // 2
            same = self._head(i[open_], middle) == self._head(j[open_], middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1

    def _next(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The byte after the first ``n``, -1 at the end."""
        place = self.at[i] + n if self.step > 0 else self.at[i] - n - 1
        inside = n < self.length[i]
        return np.where(inside, self.raw[np.where(inside, place, 0)].astype(np.int64), -1)

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix ``i`` sorts before suffix ``j``; equal ones by their number."""
        n = self.common(i, j)
        a, b = self._next(i, n), self._next(j, n)
        return (a < b) | ((a == b) & (i < j))

    def sorted(self, group: np.ndarray) -> np.ndarray:
        """Numbers of all suffixes, sorted within their groups. ``group`` is ascending."""
        total = len(group)
        order = np.arange(total)
        if not total:
            return order
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(first, total))
        begin, end = np.repeat(first, size), np.repeat(first + size, size)
        inside = np.arange(total) - begin
        width = 1
        while width < size.max():
            run = begin + inside // width * width  # where the own run begins
            left = inside // width % 2 == 0
            other = np.where(left, run + width, run - width)
            merging = np.flatnonzero(~left | (other < end))
            low = other[merging]
            stop = np.minimum(low + width, end[merging])
            base, mine = low.copy(), order[merging]
            while True:  # how many of the sibling run come before
                open_ = np.flatnonzero(low < stop)
                if not len(open_):
                    break
                middle = (low[open_] + stop[open_]) // 2
                earlier = self.before(order[middle], mine[open_])
                low[open_[earlier]] = middle[earlier] + 1
                stop[open_[~earlier]] = middle[~earlier]
            place = np.minimum(run[merging], other[merging]) + (merging - run[merging]) + (low - base)
            order[place] = mine
            width *= 2
        return order

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Common extension of each sorted suffix with the one before it, 0 at the beginning of a group."""
        out = np.zeros(len(order), dtype=np.int64)
        inner = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        out[inner] = self.common(order[inner - 1], order[inner])
        return out

    def verified(self, order: np.ndarray, extension: np.ndarray) -> bool:
        """Whether the extensions hold byte by byte, that is, no two hashes collided."""
        text = self.raw.tobytes()
        for k in np.flatnonzero(extension).tolist():
            n, a, b = int(extension[k]), int(self.at[order[k - 1]]), int(self.at[order[k]])
            if self.step < 0:
                a, b = a - n, b - n
            if text[a : a + n] != text[b : b + n]:
                return False
        return True


def repeated_windows(contexts: list[bytes], anchor: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Which windows occur in more than one place of their group: boolean, context by offset.

    A context is a piece of text with an anchor in it. Its window of offset o has ``length`` bytes and begins o bytes
    before the anchor; offsets ``low`` to ``high`` are inside the context. Windows of a group can only be equal at
    one offset. Two windows of offset o are equal when the contexts agree in o bytes before their anchors and in
    ``length`` - o from them on, that is, when both lie in one block of the suffixes sorted forwards, cut where
    neighbours have less in common, and in one of those sorted backwards. ``group`` is ascending.
    """
    raw = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    hashes = prefix_hashes(raw)
    at = begin + anchor
    forwards = Suffixes(raw, hashes, at, sizes - anchor)
    backwards = Suffixes(raw, hashes, at, anchor, -1)
    right, left = forwards.sorted(group), backwards.sorted(group)
    after, ahead = forwards.neighbours(right, group), backwards.neighbours(left, group)
    widest = int(high.max()) + 1 if len(high) else 0
    out = np.zeros((len(contexts), widest), dtype=bool)
    if not (forwards.verified(right, after) and backwards.verified(left, ahead)):
        return _by_bytes(contexts, anchor, group, low, high, length, out)
    starts_r = np.concatenate(([True], group[right[1:]] != group[right[:-1]]))
    starts_l = np.concatenate(([True], group[left[1:]] != group[left[:-1]]))
    blocks_r, blocks_l = np.empty(len(contexts), np.int64), np.empty(len(contexts), np.int64)
    for o in range(widest):
        rows = np.flatnonzero((low <= o) & (o <= high))
        if len(rows) < 2:
            continue
        blocks_r[right] = np.cumsum(starts_r | (after < length - o))
        blocks_l[left] = np.cumsum(starts_l | (ahead < o))
        _, back, times = np.unique(blocks_r[rows] * (len(contexts) + 1) + blocks_l[rows], return_inverse=True, return_counts=True)
        out[rows, o] = times[back] > 1
    return out


def _by_bytes(contexts, anchor, group, low, high, length, out) -> np.ndarray:
    """The same without hashes."""
    seen: dict = {}
    for i, text in enumerate(contexts):
        for o in range(int(low[i]), int(high[i]) + 1):
            begin = int(anchor[i]) - o
            seen.setdefault((int(group[i]), o, text[begin : begin + length]), []).append(i)
    for (_, o, _), found in seen.items():
        if len(found) > 1:
            out[found, o] = True
    return out
