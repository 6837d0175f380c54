"""Exact deduplication by stateful streaming.

Every row arrives in a stream with its digest, identifier and content locator (file and row). A streaming
aggregation without watermark keeps one state row per digest for ever: the smallest identifier with its locator,
and how many rows arrived. The state lives in a disk-backed store and its checkpoints in the shared folder.
Rows whose digest was seen more than once are hits: their whole texts are compared byte by byte, and a digest
shared by different texts is resolved by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textpulse.llm.common import located, read, register, small, stored, whole_text, written
from textpulse.session import scratch_path

WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: The state store is on disk. It writes changes, not whole snapshots, gives up a partition's files when its batch is
#: done, and reserves no disk ahead of what it holds.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: str = "text") -> Column:
    """The text with every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(whole_text(text), WHITE_SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def first_arrivals(spark: SparkSession, path: str, schema: StructType, bytes_per_batch: str | None = None) -> DataFrame:
    """State per digest after streaming the table at ``path``: ``digest, first, size``.

    The table has ``digest`` and ``rank``, a struct whose least value marks the row to keep. ``bytes_per_batch``
    bounds a micro-batch (null: all that has arrived).
    """
    checkpoint = scratch_path(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(schema)
        if bytes_per_batch:
            reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
        state = reader.parquet(path).groupBy("digest").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("size"))
        query = (
            state.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        kept = spark.read.format("statestore").load(checkpoint)
        kept = kept.select("key.digest", F.col("value.min").alias("first"), F.col("value.count").alias("size"))
        return written(kept, "digests")
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def exact_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
    bytes_per_batch: str | None = None,
) -> DataFrame:
    """One row per document: ``_tp_file, _tp_row, _key, digest, keep, size, kept``.

    ``keep`` is the key of the row that stays: the smallest key of the rows with equal normalised texts (null keys
    last; among repeated keys the first stored row). Null texts equal empty ones. Exactly one row of a group is
    ``kept``. Other columns are not read, an empty table gives no rows.
    """
    rows = located(docs)
    rank = F.struct(F.col(key).isNull().alias("absent"), F.col(key).alias("key"), F.col("_tp_file"), F.col("_tp_row"))
    arriving = rows.select(digest(normalised(text)).alias("digest"), rank.alias("rank"))
    path = stored(arriving, "arrivals")
    arrivals = docs.sparkSession.read.schema(arriving.schema).parquet(path)
    if arrivals.isEmpty():  # nothing to stream, and no state to read
        groups = arrivals.select("digest", F.col("rank").alias("first"), F.lit(1).cast("long").alias("size"))
    else:
        groups = first_arrivals(docs.sparkSession, path, arriving.schema, bytes_per_batch)

    # Check the bytes of all hits. Copies meet in the map tasks first, so a hot group moves one text per task.
    hits = groups.filter("size > 1").select("digest")
    checked = (
        rows.select(normalised(text).alias("_text"))
        .withColumn("digest", digest(F.col("_text")))
        .join(small(hits), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min("_text").alias("low"), F.max("_text").alias("high"))
    )
    clashes = written(checked.filter("low != high").select("digest"), "clashes")

    decided = arrivals.join(groups, "digest").select("digest", "rank", "first", "size")
    if not clashes.isEmpty():
        same = Window.partitionBy("digest", "_text")
        apart = (
            rows.select(normalised(text).alias("_text"), rank.alias("rank"))
            .withColumn("digest", digest(F.col("_text")))
            .join(clashes, "digest", "left_semi")
            .select("digest", "rank", F.min("rank").over(same).alias("first"), F.count(F.lit(1)).over(same).alias("size"))
        )
        decided = decided.join(clashes, "digest", "left_anti").unionByName(apart)
    return decided.select(
        F.col("rank._tp_file").alias("_tp_file"),
        F.col("rank._tp_row").alias("_tp_row"),
        F.col("rank.key").alias("_key"),
        "digest",
        F.col("first.key").alias("keep"),
        "size",
        (F.col("rank") == F.col("first")).alias("kept"),
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    rows = located(docs)
    drops = written(exact_groups(rows.drop("_tp_file", "_tp_row"), key, text).filter(~F.col("kept")).select("_tp_file", "_tp_row"), "drops")
    return rows.join(small(drops), ["_tp_file", "_tp_row"], "left_anti").drop("_tp_file", "_tp_row")


_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""


@register("op8_streaming_exact_dedup", _SQL)
def op8_streaming_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every document with its digest, by the streaming state over all documents."""
    groups = exact_groups(read(spark, folder, "documents"))
    return groups.select(
        F.col("_key").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
