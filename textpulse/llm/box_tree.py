"""A tree of minimum bounding boxes over integer vectors, packed by sort-tile-recursive slices, and its search by score.

The inner product of a query and any vector of a box lies between the sums, over the coordinates, of the smaller and of
the larger product of the query's component with the box's two ends. A search takes the boxes of a query best first,
by their upper ends, and leaves out those that lie outside the score window or strictly below the k-th best score.
"""

from __future__ import annotations

import math

import numpy as np

#: Vectors of a leaf, and leaves of a node.
LEAF, FAN = 64, 8
NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def packed_order(values: np.ndarray, ids: np.ndarray, coordinates: list[int], leaf: int = LEAF) -> np.ndarray:
    """Order of the rows by slices: sorted by the first coordinate and cut into slabs, each by the next, and so on."""
    n = len(values)
    if not coordinates or n <= leaf:
        return np.arange(n)
    order = np.lexsort((ids, values[:, coordinates[0]]))
    if len(coordinates) == 1:
        return order
    pages = -(-n // leaf)
    size = leaf * -(-pages // math.ceil(pages ** (1 / len(coordinates))))
    slabs = (order[i : i + size] for i in range(0, n, size))
    return np.concatenate([s[packed_order(values[s], ids[s], coordinates[1:], leaf)] for s in slabs])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices: by floating point where that holds them exactly."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of every query with anything in every box."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


class Search:
    """The best ``k`` vectors of every query and score window, over blocks of vectors that come one after the other.

    ``windows`` are least and greatest scores, one or more a query (an empty one has its ends crossed). Vectors with
    the query's label count if ``same``, else those with another one; the query's own id never does. Higher scores come
    first, ties by the smaller id.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, windows: tuple[np.ndarray, np.ndarray], same: bool, k: int):
        self.ids, self.labels, self.values, self.same, self.k = ids, labels, values, same, k
        self.least, self.most = windows
        shape = (*self.least.shape, k)
        self.score, self.found = np.full(shape, NONE), np.full(shape, _LAST)
        self.leaves = 0  # read so far

    def _needed(self, who: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the box with these bounds (one row a query of ``who``) can add to any window of the query."""
        bound = np.maximum(self.least[who], self.score[who, :, -1])
        out = np.zeros(low.shape, dtype=bool)
        for w in range(bound.shape[1]):
            out |= (high >= bound[:, w : w + 1]) & (low <= self.most[who, w][:, None]) & (self.least[who, w] <= self.most[who, w])[:, None]
        return out

    def add(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, coordinates: list[int]) -> None:
        """Search one block of vectors."""
        order = packed_order(values, ids, coordinates)
        ids, labels, values = ids[order], labels[order], values[order]
        starts = np.arange(0, len(values), LEAF)
        low, high = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
        nodes = np.arange(0, len(starts), FAN)
        who = np.arange(len(self.ids))
        root = bounds(self.values, low.min(axis=0, keepdims=True), high.max(axis=0, keepdims=True))
        who = who[self._needed(who, *root)[:, 0]]
        inner = bounds(self.values[who], np.minimum.reduceat(low, nodes), np.maximum.reduceat(high, nodes))
        open_ = np.repeat(self._needed(who, *inner), FAN, axis=1)[:, : len(starts)]
        who, open_ = who[open_.any(axis=1)], open_[open_.any(axis=1)]
        least, most = bounds(self.values[who], low, high)
        most[~open_] = NONE
        queue = np.argsort(~most, axis=1, kind="stable")
        for turn in range(len(starts)):
            leaf = queue[:, turn]
            at = np.arange(len(who))
            upper = most[at, leaf]
            # What comes later in a queue lies no higher: a query ends when all its windows are past it.
            going = (upper[:, None] >= np.maximum(self.least[who], self.score[who, :, -1])).any(axis=1) & (upper > NONE)
            if not going.all():
                who, queue, least, most = who[going], queue[going], least[going], most[going]
                leaf, at = leaf[going], np.arange(len(who))
            if not len(who):
                return
            take = self._needed(who, least[at, leaf][:, None], most[at, leaf][:, None])[:, 0]
            self._read(who[take], leaf[take], ids, labels, values)

    def _read(self, who: np.ndarray, leaf: np.ndarray, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
        """Score the vectors of one leaf for each of ``who``."""
        self.leaves += len(who)
        order = np.argsort(leaf, kind="stable")
        who, leaf = who[order], leaf[order]
        kept = []
        floor = np.maximum(self.least[who], self.score[who, :, -1]).min(axis=1)
        roof = self.most[who].max(axis=1)
        edges = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            some, rows = who[a:b], slice(leaf[a] * LEAF, (leaf[a] + 1) * LEAF)
            scores = product(self.values[some], values[rows])
            ok = (scores >= floor[a:b, None]) & (scores <= roof[a:b, None])
            ok &= ((self.labels[some][:, None] == labels[rows][None, :]) == self.same) & (self.ids[some][:, None] != ids[rows][None, :])
            i, j = np.nonzero(ok)
            kept.append((some[i], scores[i, j], ids[rows][j]))
        if kept:
            self._merge(*[np.concatenate(x) for x in zip(*kept)])

    def _merge(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take scored vectors into the best of every window that they fit."""
        width = self.least.shape[1]
        fits = (scores[:, None] >= self.least[who]) & (scores[:, None] <= self.most[who])
        i, w = np.nonzero(fits)
        slots = who[i] * width + w
        touched = np.unique(slots)
        old_score, old_id = self.score.reshape(-1, self.k)[touched], self.found.reshape(-1, self.k)[touched]
        slot = np.concatenate([slots, np.repeat(touched, self.k)])
        score, found = np.concatenate([scores[i], old_score.ravel()]), np.concatenate([ids[i], old_id.ravel()])
        order = np.lexsort((found, ~score, slot))  # the complement sorts from the greatest, and does not overflow
        slot, score, found = slot[order], score[order], found[order]
        first = np.searchsorted(slot, touched)
        pick = first[:, None] + np.arange(self.k)
        self.score.reshape(-1, self.k)[touched] = score[pick]
        self.found.reshape(-1, self.k)[touched] = found[pick]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the queries, their windows, ids and scores of what was found."""
        who, window, place = np.nonzero(self.score > NONE)
        return who, window, self.found[who, window, place], self.score[who, window, place]

