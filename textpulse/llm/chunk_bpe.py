"""Exact BPE ids of whole texts by way of content-defined chunks, and the way back.

A rolling hash over a few bytes cuts every text at places that depend on those bytes alone, so that passages which
texts share are cut alike. A task encodes each distinct chunk once while it remembers it, and puts the ids of a text
together from its chunks. A chunk's first and last words may be parts of words; where a word goes across a join, the
text around the join is encoded again, between words whose ids must come out as the chunks have them.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from textpulse.llm.common import read, register, small_batches
from textpulse.llm.shingles import mixed, prefix_hashes, span_hashes
from textpulse.llm.words import id_lists, runs

#: Bytes that a cut depends on; chunks have MEAN bytes on average beyond LEAST, and MOST at most.
WINDOW, LEAST, MEAN, MOST = 16, 64, 512, 16_384
#: Bytes that a task remembers of chunks and of words.
CHUNK_BYTES, WORD_BYTES = 64 << 20, 64 << 20
#: Words that the library gets in one text, and the length beyond which a word is not remembered.
_TOGETHER, _LONG = 256, 64
#: Signs that the word splitting of the language counts as white space, but the library does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_WORD = re.compile("[^ \t\n\r]+")


def cuts(raw: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes, which lie between characters."""
    n = len(raw)
    found: list[int] = []
    at = np.arange(WINDOW, n)
    if len(at):
        hashes = mixed(span_hashes(prefix_hashes(raw), at - WINDOW, at))
        found = at[(hashes % np.uint64(MEAN) == 0) & (raw[WINDOW:] & 0xC0 != 0x80)].tolist()
    out, last = [], 0
    for end in [*found, n]:
        while end - last > MOST:
            last += MOST
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if end - last >= LEAST or end == n:
            out.append(end)
            last = end
    return out if n else []


def words(text: str) -> list[str]:
    """What stands between white space. No pre-token goes across white space, whatever kind it is."""
    return _WORD.findall(text) if _NOT_SPACE.search(text) else text.split()


class Recent:
    """Values by key, made for many keys at a time. About ``limit`` bytes are remembered: at half of that, what there is
    becomes old, and of the old only what comes again is taken over."""

    def __init__(self, make: Callable[[list], list], size: Callable[[object, object], int], limit: int):
        self.make, self.size, self.limit = make, size, limit
        self.now: dict = {}
        self.old: dict = {}
        self.used = self.made = 0

    def take(self, keys: set) -> dict:
        """A table with all the keys in it; it holds until the next call."""
        if self.used > self.limit // 2:
            self.old, self.now, self.used = self.now, {}, 0
        new = keys.difference(self.now)
        again = {k: self.old[k] for k in new if k in self.old}
        unseen = list(new.difference(again)) if again else list(new)
        self.made += len(unseen)
        again.update(zip(unseen, self.make(unseen), strict=True))
        self.used += sum(self.size(k, v) for k, v in again.items())
        self.now.update(again)
        return self.now


@dataclass(slots=True)
class Chunk:
    """Ids (four bytes each) of a chunk by itself, and its outer words with their ids."""

    ids: bytes
    n: int  # words
    first: tuple[str, bytes]
    second: tuple[str, bytes]
    last: tuple[str, bytes]
    but_last: tuple[str, bytes]
    starts: bool  # begins with white space
    ends: bool  # ends with it


_NO_WORD = ("", b"")
_EMPTY = Chunk(b"", 0, _NO_WORD, _NO_WORD, _NO_WORD, _NO_WORD, True, True)


class ChunkEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.repaired = self.whole = 0  # joins, and texts that were encoded whole as a join did not agree
        self.forget()

    def forget(self) -> None:
        self.words = Recent(self._encode_words, lambda w, ids: 120 + len(w) + len(ids), WORD_BYTES)
        self.chunks = Recent(self._encode_chunks, lambda raw, c: 600 + len(raw) + len(c.ids), CHUNK_BYTES)

    def alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _encode_words(self, some: list[str]) -> list[bytes]:
        """Ids of words; many go to the library in one text, whose offsets tell which ids are whose."""
        out: list[bytes] = []
        texts = [some[i : i + _TOGETHER] for i in range(0, len(some), _TOGETHER)]
        for group, coded in zip(texts, self.tokenizer.encode_batch([" ".join(g) for g in texts], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, dtype="<u4").tobytes()
            begins = np.fromiter((o[0] for o in coded.offsets), dtype=np.int64, count=len(coded.ids))
            sizes = np.fromiter(map(len, group), dtype=np.int64, count=len(group)) + 1
            at = (4 * np.searchsorted(begins, np.cumsum(sizes) - sizes)).tolist()
            out.extend(ids[a:b] for a, b in zip(at, [*at[1:], len(ids)], strict=True))
        return out

    def _encode_chunks(self, raws: list[bytes]) -> list[Chunk]:
        texts = [raw.decode() for raw in raws]
        split = [words(t) for t in texts]
        table = self.words.take({w for some in split for w in some if len(w) <= _LONG})
        out = []
        for text, some in zip(texts, split, strict=True):
            if not some:
                out.append(_EMPTY)
                continue
            ids = [table[w] if len(w) <= _LONG else self.alone(w) for w in some]
            pairs = [(some[0], ids[0]), (some[1], ids[1]) if len(some) > 1 else _NO_WORD]
            pairs += [(some[-1], ids[-1]), (some[-2], ids[-2]) if len(some) > 1 else _NO_WORD]
            out.append(Chunk(b"".join(ids), len(some), *pairs, not text.startswith(some[0]), not text.endswith(some[-1])))
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, four bytes each."""
        split = []
        for text in texts:
            raw = text.encode()
            ends = cuts(np.frombuffer(raw, dtype=np.uint8))
            split.append([raw[a:b] for a, b in zip([0, *ends], ends)])
        table = self.chunks.take({raw for some in split for raw in some})
        joins: list[Join] = []
        put = [_assembled([table[raw] for raw in some], joins) for some in split]
        self.repaired += len(joins)
        again = self.tokenizer.encode_batch_fast([j.text for j in joins], add_special_tokens=False)
        found = [j.agreed(np.array(e.ids, dtype="<u4").tobytes()) for j, e in zip(joins, again, strict=True)]
        out = []
        for text, parts in zip(texts, put, strict=True):
            done = [found[p] if isinstance(p, int) else p for p in parts]
            if any(d is None for d in done):
                self.whole += 1
                done = [self.alone(text)]
            out.append(b"".join(done))
        return out


@dataclass(slots=True)
class Join:
    """A word that goes across the joins of chunks, between its neighbours in the chunks."""

    left: tuple[str, bytes]
    word: str
    right: tuple[str, bytes]

    @property
    def text(self) -> str:
        return " ".join(w for w in (self.left[0], self.word, self.right[0]) if w)

    def agreed(self, ids: bytes) -> bytes | None:
        """The word's ids, if the neighbours have the ids around them that they have in their chunks."""
        a, b = self.left[1], self.right[1]
        if len(ids) < len(a) + len(b) or not ids.startswith(a) or not ids.endswith(b):
            return None
        return ids[len(a) : len(ids) - len(b)]


def _assembled(chunks: list[Chunk], joins: list[Join]) -> list[bytes | int]:
    """Ids of a text in parts; a number stands for the ids of that one of ``joins``, to which the text's own are added."""
    out: list[bytes | int] = []
    left, pending, own = _NO_WORD, "", b""  # the last whole word, the word that may go on, and its ids if no chunk joined it
    joined = False

    def close(right: tuple[str, bytes]) -> None:
        nonlocal left, pending, joined
        if joined:
            out.append(len(joins))
            joins.append(Join(left, pending, right))
            left = _NO_WORD  # its ids are not known here; the next join has the words after it
        elif pending:
            out.append(own)
            left = (pending, own)
        pending, joined = "", False

    for c in chunks:
        begin, end = 0, len(c.ids)
        skipped = 0
        if pending:
            if c.starts:
                close(_NO_WORD)
            else:
                pending, joined = pending + c.first[0], True
                if c.n == 1 and not c.ends:
                    continue
                # a second word that is the chunk's last may itself be a part; its ids are those of the part, as in the text of the join
                close(c.second)
                begin, skipped = len(c.first[1]), 1
        if c.n > skipped:
            if not c.ends:
                end -= len(c.last[1])
                pending, own = c.last
                if c.n - skipped > 1:
                    left = c.but_last
            else:
                left = c.last
            out.append(c.ids[begin:end])
    close(_NO_WORD)
    return out


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


class Decoder:
    """Texts of ids, as the library's ``decode`` with special tokens kept."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = np.full(max(names.values(), default=-1) + 2, None, dtype=object)  # the last one stands for unknown ids
        for name, i in names.items():
            self.names[i] = name
        self.gaps = None in self.names[:-1]

    def text(self, ids: np.ndarray) -> str:
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        known = (ids >= 0) & (ids < len(self.names) - 1)
        found = self.names[np.where(known, ids, len(self.names) - 1)].tolist()
        return " ".join(found if known.all() and not self.gaps else [n for n in found if n is not None])


@functools.lru_cache(maxsize=2)
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def with_ids(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, an array of the token ids of every whole text, as the library gives them without special tokens
    around the text; special tokens that stand in a text are taken as such.

    Null and empty texts have no ids. A column of that name is replaced, all others stay; rows are independent of each
    other, so ties, repeated rows and empty tables need no rule. What a task remembers is bounded in bytes and ends
    with the task. A word is encoded whole: one without white space that fills a very long text is held by the library
    at once.
    """
    docs = docs.drop(ids)
    schema = StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        try:
            for batch, texts in runs(batches, text):
                column = id_lists(encoder.ids(texts))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=schema.names)
        finally:  # the worker lives on through other stages
            encoder.forget()

    return small_batches(docs).mapInArrow(encode, schema)


def _id_rows(column: pa.ListArray) -> Iterator[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b, known in zip(offsets, offsets[1:], column.is_valid().to_pylist()):
        yield values[a:b] if known else values[:0]


def with_text(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, decoded from the array ``ids``. Null or no ids give the empty text; ids that the vocabulary lacks
    are passed over. A column of that name is replaced."""
    docs = docs.drop(text)
    schema = StructType([*docs.schema.fields, StructField(text, StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                out = [decoder.text(row) for row in _id_rows(part.column(part.schema.get_field_index(ids)))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=schema.names)

    return small_batches(docs).mapInArrow(decode, schema)


def digests(coded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``: digests of the ids as little-endian unsigned 32-bit integers, and
    of the text that they decode to, without holding more than one of these texts."""
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = [coded.schema[key].dataType, LongType(), StringType(), StringType()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(path)
        for batch in batches:
            rows = list(_id_rows(batch.column(1)))
            own = [hashlib.sha256(row.astype("<u4").tobytes()).hexdigest() for row in rows]
            back = [hashlib.sha256(decoder.text(row).encode()).hexdigest() for row in rows]
            sizes = pa.array([len(row) for row in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(own), pa.array(back)], names=names)

    return coded.select(key, ids).mapInArrow(digest, StructType([StructField(n, t) for n, t in zip(names, kinds, strict=True)]))


@register("op12_chunk_encoding")
def op12_chunk_encoding(spark: SparkSession, folder: str) -> DataFrame:
    """Number and digest of the ids of every document, and the digest of the text decoded from them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return digests(with_ids(docs, path).select("doc_id", "ids"), path)
