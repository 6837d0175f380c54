"""Token files: Parquet with one row per document, its ids as a list column.

Documents are in ascending id order over all files (a range-partitioned sort, one file per range). Ids are
dictionary-encoded (a vocabulary fits a dictionary page), document ids delta-encoded; row groups and pages have set
sizes, and page indexes let a reader fetch single documents, or counts without tokens.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from textpulse.llm.common import read, register, small, whole_text
from textpulse.llm.part_table import BORDER, PartTable
from textpulse.llm.words import runs
from textpulse.session import scratch_path

#: Write options. Dictionary for the ids, delta for the document id (whose values never repeat), sizes in bytes.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.block.size": str(64 << 20),
    "parquet.page.size": str(1 << 20),
    "parquet.page.row.count.limit": "1024",
    "maxRecordsPerFile": "1000000",
}
_PARTS_A_CALL = 1024


class PartEncoder:
    """Ids of texts by way of their distinct parts, between which the pre-tokenizer always cuts.

    The library gets many parts in one text, with a special token between them, which no part goes across; its id
    marks where to cut. A text that holds a special token or the border sign itself is encoded alone.
    """

    def __init__(self, path: str, end_id: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.array([end_id], dtype=np.int32)
        self.table = PartTable(self._encode, end_id)

    def _alone(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)

    def _encode(self, parts: list[str]) -> list[np.ndarray]:
        if not self.special:
            return [self._alone(p) for p in parts]
        out: list[np.ndarray] = []
        mark = self.tokenizer.token_to_id(self.special[0])
        for i in range(0, len(parts), _PARTS_A_CALL):
            some = parts[i : i + _PARTS_A_CALL]
            ids = self._alone(self.special[0].join(some))
            at = np.flatnonzero(ids == mark)
            begins, ends = [0, *(at + 1).tolist()], [*at.tolist(), len(ids)]
            out.extend(ids[a:b] for a, b in zip(begins, ends, strict=True))
        return out

    def lists(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text with the end id."""
        odd = [i for i, t in enumerate(texts) if BORDER in t or any(s in t for s in self.special)]
        if odd:
            plain = {i: [*self._alone(texts[i]), *self.end] for i in odd}
            rest = self.lists(["" if i in plain else t for i, t in enumerate(texts)])
            return pa.array([plain.get(i, r) for i, r in enumerate(rest.to_pylist())], pa.list_(pa.int32()))
        values, ends = self.table.ids(texts)
        return pa.ListArray.from_arrays(pa.array(np.append([0], ends), pa.int32()), pa.array(values, pa.int32()))


@functools.lru_cache(maxsize=2)
def _encoder(path: str, end_id: int) -> PartEncoder:
    return PartEncoder(path, end_id)


def encoded(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: the ids of every whole text with ``end_id`` after them. Null texts are empty; order is kept."""
    schema = StructType([StructField(key, docs.schema[key].dataType), StructField("ids", ArrayType(IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, end_id)
        for batch, texts in runs(batches, text):
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder.lists(texts)], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(encode, schema)


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int, text: str = "text") -> None:
    """Token files of ``docs`` (``doc_id, text``) in the folder ``out``: ``doc_id, n_tokens, ids``.

    Files follow each other in ascending ``doc_id`` (null first; equal ids lie together, ordered by text). Every row
    of the input gives a row; an empty text holds just the end id; an empty table gives files without rows. Other
    columns are left out.
    """
    narrow = docs.select("doc_id", whole_text(text).alias("text"))
    ordered = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = encoded(ordered, path, end_id).select("doc_id", F.size("ids").alias("n_tokens"), "ids")
    rows.write.options(**LAYOUT).parquet(out)


def read_tokens(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of token files, of document ids ``first`` to ``last`` if given: statistics and page indexes skip the rest."""
    rows = spark.read.schema("doc_id bigint, n_tokens int, ids array<int>").parquet(folder)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    return rows if last is None else rows.filter(F.col("doc_id") <= last)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens`` of every document, from the two narrow columns alone: tokens are not read.

    ``start`` counts the tokens of all documents before. Sums run inside each file; the files' totals are one row a
    file, put in order by their least id.
    """
    rows = read_tokens(spark, folder).select(
        "doc_id", "n_tokens", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    totals = rows.groupBy("_file").agg(F.sum("n_tokens").alias("_sum"), F.min("doc_id").alias("_least"))
    before = Window.orderBy(F.col("_least").asc_nulls_first(), "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_file", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_file").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    placed = rows.withColumn("_within", within).join(small(starts), "_file")
    return placed.select("doc_id", (F.col("_start") + F.col("_within")).alias("start"), "n_tokens", "_file", "_row")


def checksums(rows: DataFrame) -> DataFrame:
    """Add ``n_ids`` and ``ids_crc32``, of the ids as little-endian unsigned 32-bit integers, and drop ``ids``."""
    kept = [f for f in rows.schema.fields if f.name != "ids"]
    schema = StructType([*kept, StructField("n_ids", LongType()), StructField("ids_crc32", LongType())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            lists = batch.column(at)
            values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            others = [c for i, c in enumerate(batch.columns) if i != at]
            sizes = pa.array(np.diff(offsets), type=pa.int64())
            yield pa.RecordBatch.from_arrays([*others, sizes, pa.array(crc, type=pa.int64())], names=schema.names)

    return rows.mapInArrow(check, schema)


@register("op9_token_files")
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place, count and checksum, read back from the token files of all documents."""
    out = scratch_path(spark, "token-files")
    write_token_files(read(spark, folder, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), 2)
    rows = read_tokens(spark, out).select(
        "doc_id", "ids", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    sums = checksums(rows).select("_file", "_row", "n_ids", "ids_crc32")
    return (
        read_index(spark, out)
        .join(sums, ["_file", "_row"])
        .select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")
    )
