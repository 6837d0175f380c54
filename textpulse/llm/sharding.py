"""Sharding by proportional stratified interleaving.

Rows of every source are shuffled by a seeded digest of their key and ranked. Rank r of n gets the fractional rank
(2r - 1) / 2n. Sorting all rows by it spreads every source evenly over the whole order, so that equal cuts of the
order have the mixture of the whole, up to one row per source and cut.

No step sorts a source or the table in one task: a source is ranked in 4096 slices of its digests, and the total
order is a range-partitioned sort whose partitions add the sizes of those before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpulse.llm.common import read, register, whole_text
from textpulse.operators.positions import with_position

_SLICE_DIGITS = 3  # hex digits: 4096 slices of a source


def fractional_ranks(rows: DataFrame, source: str, key: str, ties: list[str], seed: int = 0) -> DataFrame:
    """Add ``_fraction``, the fractional rank of a row in its seeded-shuffled source, and ``_stratum``.

    Null sources form one stratum. Rows of one source with one key follow each other by ``ties``; rows equal in
    those too are interchangeable.
    """
    stratum = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    rows = rows.withColumns({"_stratum": stratum, "_digest": digest})
    rows = rows.withColumn("_slice", F.substring("_digest", 1, _SLICE_DIGITS))
    sizes = rows.groupBy("_stratum", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    slices = Window.partitionBy("_stratum").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_stratum",
        "_slice",
        F.coalesce(F.sum("_n").over(slices), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_stratum")).alias("_size"),
    )
    inside = Window.partitionBy("_stratum", "_slice").orderBy("_digest", *ties)
    ranked = rows.withColumn("_in", F.row_number().over(inside)).join(starts, ["_stratum", "_slice"])
    fraction = (2 * (F.col("_before") + F.col("_in")) - 1) / (2 * F.col("_size"))
    return ranked.withColumn("_fraction", fraction).drop("_digest", "_slice", "_in", "_before", "_size")


def interleave(
    rows: DataFrame, shards: int, source: str = "source", key: str = "doc_id", ties: list[str] | None = None, seed: int = 0
) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 within the shard).

    Shard sizes differ by at most one row, and a shard's share of each source is within one row of its share of the whole.
    Null keys and sources count as values of their own, repeated rows each get a slot, an empty table stays empty.
    Input columns named ``shard`` or ``slot`` are replaced; names that begin with an underscore are kept for use here.
    """
    rows = rows.drop("shard", "slot")
    ranked = fractional_ranks(rows, source, key, ties or [], seed)
    placed = with_position(ranked, ["_fraction", "_stratum"], "_position")
    total = max(1, placed.count())
    at = F.col("_position") - 1
    shard = F.expr(f"(_position - 1) * {shards} div {total}")
    return (
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("slot", at - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}"))
        .drop("_position", "_fraction", "_stratum")
    )


_SHARDS, _SEED = 8, 0
# CRC-32 of the UTF-8 bytes, by a table of sixteen entries over half bytes, low half first.
_SQL = f"""
WITH crc16 AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(4)::BIGINT[]), lambda c, k:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(16))::BIGINT AS i))),
nibbles AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
         list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\\2\\1', 'g'), ''),
           lambda x: CAST(strpos('0123456789ABCDEF', x) - 1 AS BIGINT)) AS h,
         coalesce(text, '') = '' AS blank
  FROM documents),
d AS (
  SELECT doc_id, size, coalesce('=' || source, 'null') AS stratum, md5('{_SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS digest,
         CASE WHEN blank THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, h), lambda c, x:
           xor(c >> 4, t[xor(c & 15, x) + 1])), 4294967295) END AS text_crc32
  FROM nibbles, crc16),
r AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY digest, doc_id, text_crc32, size) - 1)
            / (2 * count(*) OVER (PARTITION BY stratum)) AS fraction
  FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * {_SHARDS} // n AS INTEGER) AS shard,
       place - ((place * {_SHARDS} // n) * n + {_SHARDS - 1}) // {_SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p"""


@register("op3_stratified_interleaving", _SQL)
def op3_stratified_interleaving(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document; only ids, sources, sizes and checksums are moved. Law: ``rows``."""
    text = whole_text()
    narrow = read(spark, folder, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = interleave(narrow, _SHARDS, ties=["doc_id", "text_crc32", "size"], seed=_SEED)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
