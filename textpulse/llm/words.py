"""Arrow helpers of the tokenizing operators: texts in, one list of ids per text out, over a bounded cache of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Distinct words that a task remembers.
CACHE_WORDS = 400_000
#: Texts are handled in runs of about this many characters, so that output batches stay small.
RUN_CHARS = 1_000_000


def runs(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null as empty), each of about RUN_CHARS characters or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        begin = size = 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        for i, n in enumerate(sizes):
            if size and size + n > RUN_CHARS:
                yield batch.slice(begin, i - begin), [t or "" for t in column.slice(begin, i - begin).to_pylist()]
                begin, size = i, 0
            size += n
        if begin < batch.num_rows:
            yield batch.slice(begin), [t or "" for t in column.slice(begin).to_pylist()]


def id_lists(parts: list[bytes]) -> pa.ListArray:
    """Lists of 32-bit ids from their bytes, one part per row."""
    ends = np.cumsum([0] + [len(p) // 4 for p in parts])
    values = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), values)


class WordCache(dict):
    """word -> value, filled for many words at a time by ``make``, which may sort the list that it is given.

    At half the limit the words so far become the old ones, of which those that come again are taken over.
    """

    def __init__(self, make: Callable[[list[str]], list], limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def fill(self, words: set[str]) -> None:
        new = words.difference(self)
        if len(self) + len(new) > self.limit // 2:
            self.old = dict(self)
            self.clear()
            new = words
        again = {w: self.old[w] for w in new if w in self.old}
        self.update(again)
        unseen = list(new.difference(again))
        self.update(zip(unseen, self.make(unseen), strict=True))
