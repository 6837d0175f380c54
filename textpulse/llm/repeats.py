"""Removal of long repeated strings over a corpus, by sorted suffixes.

Every byte is removed that lies in a string of LENGTH bytes which also starts anywhere else. The suffixes of all
bytes need not be sorted for that. Each window of LENGTH bytes has an anchor, the place of its least hashed string
of ANCHOR bytes, which depends on the window's bytes alone; so equal windows have equal anchors at equal offsets.
Windows that follow each other with one anchor form a piece of text.

1. Pieces are counted by anchor hash and digest. All windows of a piece that occurs twice are repeated.
2. An anchor that occurs once has no repeated window. What is left are single pieces whose anchor occurs elsewhere,
   at the ends of repeated passages: a small share of the text. They meet, one of each kind, by anchor hash, and
   their suffixes from the anchor are sorted forwards and backwards (``suffix_sort``) to tell which windows repeat.
3. An anchor with very many different pieces is dealt out to several tasks; the different windows that each of them
   has are then counted by their digests over all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.common import numbered, read, register, small, small_batches, whole_text, written
from textpulse.llm.shingles import mixed, prefix_hashes, span_hashes
from textpulse.llm.suffix_sort import repeated_windows
from textpulse.llm.words import runs

#: Bytes of a string that counts as repeated, and of an anchor inside it.
LENGTH, ANCHOR = 400, 200
#: Most different pieces of one anchor that a task sorts together.
TOGETHER = 16_000
_ROWS = 2048  # pieces that are sorted in one go, groups of them kept whole


def pieces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, anchor place, first and last window start of all pieces of a text, in order."""
    if len(raw) < LENGTH:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none
    hashes = prefix_hashes(raw)
    count = len(raw) - ANCHOR + 1
    every = mixed(span_hashes(hashes, np.arange(count), np.arange(count) + ANCHOR))
    # Order by the hash's upper half, then by place: the least one is the leftmost of equal ones.
    ranked = (every & np.uint64(0xFFFFFFFF00000000)) | np.arange(count, dtype=np.uint64)
    span = LENGTH - ANCHOR + 1
    padded = np.full(-(-count // span) * span, np.iinfo(np.uint64).max)
    padded[:count] = ranked
    grid = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = count - span + 1
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(first[1:], windows) - 1
    return every[place[first]].view(np.int64), place[first], first, last


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _pieces(rows: DataFrame) -> DataFrame:
    """``uid, place, first, last, anchor, digest`` of all pieces of ``rows`` (uid, text), stored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches, "text"):
            uids = batch.column(0).to_numpy()
            parts = [[] for _ in range(6)]
            for uid, text in zip(uids, texts):
                raw = _bytes(text)
                anchor, place, first, last = pieces(np.frombuffer(raw, dtype=np.uint8))
                digest = [hashlib.blake2b(raw[a : b + LENGTH], digest_size=8).digest() for a, b in zip(first.tolist(), last.tolist())]
                for out, column in zip(parts, (np.full(len(anchor), uid), place, first, last, anchor, np.frombuffer(b"".join(digest), "<i8")), strict=True):
                    out.append(column)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p), pa.int64()) for p in parts], names=["uid", "place", "first", "last", "anchor", "digest"])

    return written(rows.mapInArrow(cut, "uid bigint, place bigint, first bigint, last bigint, anchor bigint, digest bigint"), "pieces")


def _contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (uid, place, first, last, anchor, salt, salts, single) with ``bytes``, the piece's text."""
    fields = ["uid", "place", "first", "last", "anchor", "salt", "salts", "single"]
    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct(*fields[1:])).alias("wanted"))  # bounded by the text
    joined = rows.join(small(written(lists, "wanted"), 300_000), "uid").select("uid", "text", "wanted")
    types = "uid bigint, place bigint, first bigint, last bigint, anchor bigint, salt bigint, salts bigint, single boolean, bytes binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches, "text"):
            out = []
            for uid, text, some in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()):
                raw = _bytes(text)
                out.extend({"uid": uid, **w, "bytes": raw[w["first"] : w["last"] + LENGTH]} for w in some)
            columns = [pa.array([o[c] for o in out], t) for c, t in zip(fields, [pa.int64()] * 7 + [pa.bool_()])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([o["bytes"] for o in out], pa.binary())], names=[*fields, "bytes"])

    return joined.mapInArrow(cut, types)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about _ROWS rows, cut between rows of different (anchor, salt); the rows come sorted by them."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            kept.append(batch.slice(i, _ROWS))
            if sum(b.num_rows for b in kept) < _ROWS:
                continue
            table = pa.Table.from_batches(kept).combine_chunks()
            anchor, salt = table["anchor"].to_numpy(), table["salt"].to_numpy()
            change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
            if len(change):
                yield table.slice(0, int(change[-1]))
                kept = table.slice(int(change[-1])).combine_chunks().to_batches()
    if kept and sum(b.num_rows for b in kept):
        yield pa.Table.from_batches(kept).combine_chunks()


def _sorted_windows(contexts: DataFrame) -> DataFrame:
    """Of every group (anchor, salt): repeated spans ``uid, begin, end`` of single pieces, and for anchors dealt out to
    several tasks also rows ``key, uid, begin`` of the different windows, uid null where they need no answer."""
    dealt = contexts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            anchor, salt, uid, first = (table[c].to_numpy() for c in ("anchor", "salt", "uid", "first"))
            place, last, single, salts = (table[c].to_numpy() for c in ("place", "last", "single", "salts"))
            texts = table["bytes"].to_pylist()
            change = np.concatenate(([False], (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])))
            low, high = place - last, place - first
            found = repeated_windows(texts, place - first, np.cumsum(change), low, high, LENGTH)
            keys, uids, begins, ends = [], [], [], []
            for i in np.flatnonzero(single).tolist():
                edges = np.flatnonzero(np.diff(np.concatenate(([0], found[i].astype(np.int8), [0]))))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):  # offsets a to b - 1
                    keys.append(None)
                    uids.append(uid[i])
                    begins.append(place[i] - b + 1)
                    ends.append(place[i] - a + LENGTH)
            sent: set[bytes] = set()
            for i in np.flatnonzero(salts > 1).tolist():
                for o in range(int(low[i]), int(high[i]) + 1):
                    begin = int(place[i] - first[i]) - o
                    answer = bool(single[i]) and not found[i, o]
                    key = hashlib.blake2b(texts[i][begin : begin + LENGTH], digest_size=16).digest()
                    if answer or key not in sent:
                        if not answer:
                            sent.add(key)
                        keys.append(key)
                        uids.append(uid[i] if answer else None)
                        begins.append(place[i] - o)
                        ends.append(place[i] - o + LENGTH)
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((keys, uids, begins, ends), types)], names=["key", "uid", "begin", "end"])

    return written(dealt.mapInArrow(sort, "key binary, uid bigint, begin bigint, end bigint"), "sorted-windows")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """``uid, begin, end``: byte spans of ``rows`` (uid, text) covered by repeated strings; spans may overlap."""
    table = _pieces(rows)
    classes = table.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("uid", "place", "first", "last")).alias("one")
    )
    classes = written(classes, "piece-classes")
    often = classes.filter("times > 1").select("anchor", "digest")
    whole = table.join(small(often), ["anchor", "digest"], "left_semi").select("uid", F.col("first").alias("begin"), (F.col("last") + LENGTH).alias("end"))

    anchors = classes.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum(F.when(F.col("times") == 1, 1).otherwise(0)).alias("singles")
    )
    mixed_up = written(anchors.filter("kinds > 1 and singles > 0").select("anchor", F.ceil(F.col("kinds") / TOGETHER).alias("salts")), "mixed-anchors")
    wanted = classes.join(small(mixed_up), "anchor").select(
        "one.*", "anchor", F.pmod(F.xxhash64("digest"), F.col("salts")).alias("salt"), "salts", (F.col("times") == 1).alias("single")
    )
    sorted_ = _sorted_windows(_contexts(rows, wanted))
    local = sorted_.filter("key is null").select("uid", "begin", "end")
    shared = sorted_.filter("key is not null")
    twice = shared.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    late = shared.filter("uid is not null").join(twice, "key").select("uid", "begin", "end")
    return whole.unionByName(local).unionByName(late)


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_bytes, spans, kept``: UTF-8 bytes, maximal removed spans (begin, end), and the remaining bytes.

    A byte goes if a string of LENGTH bytes around it also starts somewhere else, in this text or another; strings are
    judged on the input, may overlap, and do not go across texts. A null text is empty; repeated rows repeat each
    other's strings; shorter texts stay whole. Columns of these names are replaced, all others are kept.
    """
    docs = numbered(docs.drop("n_bytes", "spans", "kept"))
    rows = small_batches(docs).select(F.col("_tp_uid").alias("uid"), whole_text(text).alias("text"))
    spans = repeated_spans(rows).groupBy("uid").agg(F.collect_set(F.struct("begin", "end")).alias("_spans"))  # bounded by the text
    spans = spans.withColumnRenamed("uid", "_tp_uid")
    joined = docs.join(small(written(spans, "repeated-spans"), 300_000), "_tp_uid", "left")
    fields = [f for f in joined.schema.fields if f.name not in ("_tp_uid", "_spans")]
    kept_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches, text):
            found = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
            sizes, spans_of, kept = [], [], []
            for t, some in zip(texts, found):
                raw, merged, out, at = _bytes(t), [], [], 0
                for a, b in sorted((s["begin"], s["end"]) for s in some or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                for a, b in merged:
                    out.append(raw[at:a])
                    at = b
                sizes.append(len(raw))
                spans_of.append([{"begin": a, "end": b} for a, b in merged])
                kept.append(b"".join([*out, raw[at:]]))
            others = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            added = [pa.array(sizes, pa.int64()), pa.array(spans_of, span_type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*others, *added], names=[*(f.name for f in fields), "n_bytes", "spans", "kept"])

    return joined.mapInArrow(cut, f"{kept_types}, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary")


@register("op4_sorted_suffix_repeats")
def op4_sorted_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What is removed from every document as repeated strings of 400 bytes, and a digest of the rest."""
    out = without_repeats(read(spark, folder, "documents").select("doc_id", "text")).drop("text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
