"""SentencePiece encoding and decoding by a table of prefixes.

Byte-pair encoding gives every prefix of a text exactly one last token. The token at an end position is the one
match of the vocabulary there that is compatible with the last token of the prefix before it; two tokens are
compatible when merging their joined text gives back just these two. An automaton lists the matches, a table over
the prefixes holds the last tokens, and the ids are read from it backwards. Each position costs a few look-ups,
however long the text is.

No piece goes on past a space or a line break, or from a letter to punctuation, so a text is encoded word by word
and equal words are encoded once. That is checked against the vocabulary; with other vocabularies words are longer,
or whole texts are encoded at once.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from textpulse.llm.common import read, register, small_batches
from textpulse.llm.words import CACHE_WORDS, WordCache, id_lists, runs

SPACE = "▁"  # stands for a space in pieces
_PAIRS = 300_000  # remembered compatibility tests of a task
#: Distinct words, and distinct runs of ids, that a task remembers that encodes and decodes.
BOTH_WORDS = CACHE_WORDS // 4
_PLAIN_WORD = re.compile(r"\n| +[^ \n]*|[^ \n]+")
_PUNCTUATION = r"!-/:-@\[-`{-~"
#: As above, and cut between a letter and ASCII punctuation after it.
_REST = rf"[^\W\d_]*(?:(?:[\d]|[^\w \n{_PUNCTUATION}])(?:[^\w \n]|[\d_])*[^\W\d_]*)*"
_WORD = re.compile(rf"\n| +(?:[^\w \n]|[\d_])*{_REST}|(?:[^\w \n]|[\d_])+{_REST}|[^\W\d_]{_REST}")


class PieceModel:
    """Vocabulary of a byte-pair SentencePiece model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(len(self.pieces)) if model.is_control(i)}
        self.text = {i: p.replace(SPACE, " ") for i, p in enumerate(self.pieces) if not model.is_byte(i)}
        self.text |= {i: "" for i in self.silent} | {model.unk_id(): " ⁇ "}
        plain = [i for i in range(len(self.pieces)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.id = {self.pieces[i]: i for i in plain}
        self.unknown = model.unk_id()
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.by_word = not any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.id)
        self.word = _PLAIN_WORD if any(re.search(rf"[^\W\d_][{_PUNCTUATION}]", p) for p in self.id) else _WORD
        self._compatible: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The defining procedure: join the adjacent pair of best score, the leftmost first, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the text of two tokens is encoded as just these two; ``left`` -1: nothing stands before."""
        key = left * len(self.pieces) + right
        known = self._compatible.get(key)
        if known is None:
            pair = [self.pieces[i] for i in (left, right) if i >= 0]
            known = self.merged("".join(pair)) == pair
            if len(self._compatible) >= _PAIRS:
                self._compatible.clear()
            self._compatible[key] = known
        return known

    def encode_marked(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of texts in which spaces are marked. A text goes on with the table of the one before it, as far as both
        begin alike; so give many in ascending order."""
        known, size, compatible, matches = self._compatible.get, len(self.pieces), self.compatible, self.automaton.iter
        before, last, begin = "", [-1], [-1]
        for text in texts:
            n, same = len(text), 0
            for a, b in zip(before, text):
                if a != b:
                    break
                same += 1
            # Last token of each prefix, and where it begins; -1: none, as its last character is outside the vocabulary.
            last[same + 1 :] = [-1] * (n - same)
            begin[same + 1 :] = range(same, n)
            for at, (token, length) in matches(text):  # by end, the longest match first
                if at < same:
                    continue
                end = at + 1
                if last[end] >= 0:
                    continue
                fits = known(last[end - length] * size + token)
                if fits is None:
                    fits = compatible(last[end - length], token)
                if fits:
                    last[end] = token
                    begin[end] = end - length
            before = text
            ids: list[int] = []
            end = n
            while end:
                if last[end] >= 0:
                    ids.append(last[end])
                else:
                    raw = text[begin[end] : end].encode()
                    ids.extend([self.bytes[b] for b in reversed(raw)] if self.bytes else [self.unknown])
                end = begin[end]
            ids.reverse()
            yield ids

    def words(self, text: str) -> list[str]:
        """Parts of a text, the first with a space put before it, that are encoded on their own."""
        if not text:
            return []
        text = " " + text.replace(SPACE, " ")
        return self.word.findall(text) if self.by_word else [text]

    def encode_words(self, words: Iterable[str]) -> Iterator[list[int]]:
        return self.encode_marked(w.replace(" ", SPACE) for w in words)

    def decode_raw(self, ids: Sequence[int]) -> str:
        """Text of ids with the space put before it; broken byte runs become replacement characters."""
        try:
            return "".join([self.text[i] for i in ids])
        except KeyError:  # bytes among them
            pass
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            out.append(self.text[i])
        if raw:
            out.append(_utf8(raw))
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_words(self.words(text)) for i in ids]

    def unspaced(self, ids: Iterable[int], text: str) -> str:
        """``text`` without the space put before it, if its first piece has one."""
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text

    def decode(self, ids: list[int]) -> str:
        return self.unspaced(ids, self.decode_raw(ids))


def _utf8(raw: bytes | bytearray) -> str:
    """Decoded bytes; each byte that belongs to no character becomes one replacement character."""
    raw, out, i = bytes(raw), [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


@functools.lru_cache(maxsize=2)
def _encoder(path: str, limit: int = CACHE_WORDS) -> WordCache:
    model = piece_model(path)

    def encode(words: list[str]) -> list[bytes]:
        words.sort()
        return [array("i", ids).tobytes() for ids in model.encode_words(words)]

    return WordCache(encode, limit)


def _encoded(
    batches: Iterator[pa.RecordBatch], model_path: str, text: str, ids: str, limit: int = CACHE_WORDS
) -> Iterator[pa.RecordBatch]:
    model, cache = piece_model(model_path), _encoder(model_path, limit)
    try:
        for batch, texts in runs(batches, text):
            split = [model.words(t) for t in texts]
            cache.fill(set().union(*split))
            yield _plus(batch, ids, id_lists([b"".join(map(cache.__getitem__, words)) for words in split]))
    finally:  # a worker lives on through other stages, which need the memory
        cache.forget()


def _decoded(
    batches: Iterator[pa.RecordBatch], model_path: str, ids: str, text: str, limit: int = CACHE_WORDS
) -> Iterator[pa.RecordBatch]:
    model = piece_model(model_path)
    starts = np.array([p.startswith(SPACE) for p in model.pieces])
    cache = WordCache(lambda keys: [model.decode_raw(memoryview(k).cast("i")) for k in keys], limit)
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(ids))
        for i in range(0, batch.num_rows, 256):
            part = column.slice(i, 256)
            rows = list(_rows(part))
            split = [_id_runs(row, starts) for row in rows]
            cache.fill(set().union(*split))
            out = [model.unspaced(map(int, row), "".join(map(cache.__getitem__, keys))) for row, keys in zip(rows, split, strict=True)]
            yield _plus(batch.slice(i, 256), text, pa.array(out, type=pa.string()))


def with_ids(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, the token ids of every whole text, as an array of int.

    Null and empty texts have no ids. A column of that name is replaced, all others stay as they are; rows are
    independent of each other, so ties, repeated rows and empty tables need no rule.
    """
    docs = docs.drop(ids)
    schema = StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType()))])
    return small_batches(docs).mapInArrow(lambda batches: _encoded(batches, model_path, text, ids), schema)


def with_text(docs: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, decoded from the array ``ids``; null ids decode to the empty text.

    Ids are taken apart at pieces that begin with a space, and equal runs of ids are decoded once per task.
    """
    docs = docs.drop(text)
    schema = StructType([*docs.schema.fields, StructField(text, StringType())])
    return small_batches(docs).mapInArrow(lambda batches: _decoded(batches, model_path, ids, text), schema)


def with_ids_and_text(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``with_text`` of ``with_ids``, by one Python worker a task, which loads the model once.

    It remembers words and runs of ids at once, and so a quarter as many of each.
    """
    docs = docs.drop(ids, decoded)
    more = [StructField(ids, ArrayType(IntegerType())), StructField(decoded, StringType())]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _decoded(_encoded(batches, model_path, text, ids, BOTH_WORDS), model_path, ids, decoded, BOTH_WORDS)

    return small_batches(docs).mapInArrow(code, StructType([*docs.schema.fields, *more]))


def _rows(column: pa.ListArray) -> Iterator[np.ndarray]:
    values = column.values.to_numpy(zero_copy_only=False).astype("<i4")
    offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield values[offsets[i] : offsets[i + 1]] if valid[i] else values[:0]


def _id_runs(ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    raw = ids.tobytes()
    at = np.flatnonzero(starts[ids]).tolist()
    cuts = [0, *[4 * i for i in at if i], len(raw)]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


def _plus(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


@register("op6_piece_encoding")
def op6_piece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    """Number and digest of the ids of every document, and the digest of the text decoded from them."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = read(spark, folder, "documents").select("doc_id", "text")
    coded = with_text(with_ids(docs, path).drop("text"), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
