"""Hard negatives: for every anchor and positive, the best other-label vectors that score a little below the positive.

All vectors are packed into blocks by sort-tile-recursive slices over the whole table (two range-partitioned orders),
and blocks into groups. Every group is searched for every part of the anchors by one task, which takes the group's
blocks as a stream and keeps the best of each anchor; the groups' few best rows are then merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpulse.llm.box_tree import NONE, Search
from textpulse.llm.common import read, register, written
from textpulse.operators.positions import with_position

#: Vectors of a block, anchors of a part; a task holds one block and one part, about 1 and 8 MB at 64 coordinates.
BLOCK, PART = 2048, 16_384
#: Most groups of blocks. Every group gives at most its best few rows for an anchor, so that these stay in proportion to the anchors.
GROUPS = 64
#: Coordinates that the slices are cut by: two over the table, the rest within a block.
_SLICED = 5
_LAST = np.iinfo(np.int64).max


def quantised(vector: Column, scale: int) -> Column:
    """Floor of ``scale`` times every component as a long; null where a component is null, not finite or beyond a long."""
    whole = F.transform(vector, lambda x: F.floor(scale * x.cast("double")).try_cast("bigint"))
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(2.0**53)), F.lit(False)))
    return F.when(fine, whole)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of lists; what is missing at the end of a shorter one is zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def widest_spread(vectors: DataFrame, width: int) -> list[int]:
    """The coordinates of greatest variance over all rows, at most ``_SLICED``. They steer the packing, not the result."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            x = _matrix(batch.column(0), width).astype(np.float64)
            n, one, two = n + len(x), one + x.sum(axis=0), two + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(width, dtype=np.int32), "n": np.full(width, n), "one": one, "two": two})

    found = vectors.select("_vector").mapInArrow(sums, "i int, n bigint, one double, two double").groupBy("i")
    spread = F.sum("two") / F.sum("n") - F.pow(F.sum("one") / F.sum("n"), 2)
    ranked = found.agg(F.when(F.sum("n") > 0, spread).alias("spread")).orderBy(F.desc_nulls_last("spread"), "i")
    return [r["i"] for r in ranked.limit(_SLICED).collect()]


def packed(vectors: DataFrame, total: int, coordinates: list[int]) -> DataFrame:
    """``vectors`` with ``_block``: slabs by the first coordinate, cut into blocks by the second; ties by id."""
    first, second = (coordinates * 2)[:2] if coordinates else (0, 0)
    blocks = -(-total // BLOCK)
    slab = BLOCK * -(-blocks // max(1, math.isqrt(blocks)))
    part = with_position(vectors.withColumn("_x", F.get("_vector", F.lit(first))), ["_x", "_id"], "_place")
    part = part.withColumns({"_slab": F.expr(f"(_place - 1) div {slab}"), "_x": F.get("_vector", F.lit(second))})
    part = with_position(part, ["_slab", "_x", "_id"], "_place")
    return part.withColumn("_block", F.expr(f"(_place - 1) div {BLOCK}")).drop("_slab", "_x", "_place")


def best(index: DataFrame, queries: DataFrame, total: int, asked: int, width: int, coordinates: list[int], same: bool, k: int) -> DataFrame:
    """``_id, _window, _found, _score``: of every query and window the best ``k`` of each group of blocks, and so the best of all.

    ``queries`` are ``_id, _label, _vector`` with ``_least, _most``, the windows' ends.
    """
    groups, parts = max(1, min(GROUPS, -(-total // BLOCK))), max(1, -(-asked // PART))
    blocks = max(1, -(-total // BLOCK))
    none = F.array().cast("array<bigint>")
    ask = queries.select("*", F.expr(f"cast(pmod(xxhash64(_id), {parts}) as int)").alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), F.lit(-1).cast("long").alias("_block"))
    rows = index.select(
        "*",
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"),
        F.expr(f"cast(_block * {groups} div {blocks} as int)").alias("_group"),
        none.alias("_least"),
        none.alias("_most"),
    )
    names = ["_part", "_group", "_block", "_id", "_label", "_least", "_most", "_vector"]
    dealt = ask.select(*names).unionByName(rows.select(*names))
    dealt = dealt.repartition(groups * parts, "_part", "_group").sortWithinPartitions("_part", "_group", "_block", "_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a part and group: the queries first (block -1), then the blocks in order."""
        state: Search | None = None
        now: tuple | None = None
        held: list[pa.RecordBatch] = []

        def ended() -> None:
            """The rows of ``now`` are complete."""
            nonlocal state
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids, labels = (table.column(c).to_numpy() for c in ("_id", "_label"))
            values = _matrix(table.column("_vector"), width)
            if now[2] < 0:
                windows = [np.array(table.column(c).to_pylist(), dtype=np.int64).reshape(len(ids), -1) for c in ("_least", "_most")]
                state = Search(ids, labels, values, (windows[0], windows[1]), same, k)
            elif state is not None:
                state.add(ids, labels, values, coordinates[2:] or coordinates)

        def told() -> Iterator[pa.RecordBatch]:
            if state is not None:
                who, window, found, score = state.results()
                yield pa.RecordBatch.from_pydict({"_id": state.ids[who], "_window": window, "_found": found, "_score": score})

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                key = tuple(keys[a].tolist())
                if now is not None and key != now:
                    ended()
                    held = []
                    if key[:2] != now[:2]:
                        yield from told()
                        state = None
                now = key
                held.append(batch.slice(a, b - a))
        if now is not None:
            ended()
            yield from told()

    return dealt.mapInArrow(search, "_id bigint, _window bigint, _found bigint, _score bigint")


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    vector: str = "vector",
    label: str = "label",
    positives: int = 5,
    negatives: int = 5,
    window: tuple[int, int] = (80, 100),
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of integer vectors; higher ones come first, ties by the smaller key. An anchor (a row that
    meets ``anchors``) has its first ``positives`` other rows of its label as positives; each of these gets the first
    ``negatives`` rows of another label with ``window[0] * positive <= 100 * negative <= window[1] * positive``. A
    positive without such rows, or a table without rows, gives none.

    Rows with a null key, label or vector or a null component take no part, nor do those with a component beyond the
    square root of 2^62 / coordinates, whose scores a long may not hold. Shorter vectors count as filled up with zeros.
    A key that comes more than once counts once, with its least label and then its least vector. Other columns are left
    out. Every row is in the tree and every search is exact.
    """
    given = vectors.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.forall(vector, lambda x: x.isNotNull()))
    named = given.select(
        F.col(key).cast("long").alias("_id"), F.col(label).cast("long").alias("_label"), F.col(vector).cast("array<bigint>").alias("_vector"), F.coalesce(anchors, F.lit(False)).alias("_anchor")
    )
    one = named.groupBy("_id").agg(F.min(F.struct("_label", "_vector")).alias("_first"), F.max("_anchor").alias("_anchor"))
    whole = written(one.select("_id", "_first.*", "_anchor"), "vectors")
    width = whole.agg(F.max(F.size("_vector"))).first()[0] or 0
    limit = math.isqrt((1 << 62) // max(1, width))
    whole = whole.filter(F.forall("_vector", lambda x: x.between(-limit, limit)))
    total, asked = whole.agg(F.count(F.lit(1)), F.count_if("_anchor")).first()
    coordinates = widest_spread(whole, width)
    index = written(packed(whole.drop("_anchor"), total, coordinates), "packed-vectors")
    queries = whole.filter("_anchor").drop("_anchor")

    def first(found: DataFrame, by: list[str], n: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("_score"), "_found")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)

    every = queries.withColumns({"_least": F.array(F.lit(NONE + 1)), "_most": F.array(F.lit(_LAST))})
    found = best(index, every, total, asked, width, coordinates, True, positives)
    found = written(first(found, ["_id"], positives).select("_id", "rank", "_found", "_score"), "positives")
    ends = found.withColumns({"_low": F.expr(f"cast(ceil(cast({window[0]} as decimal(38,2)) * _score / 100) as bigint)"), "_high": F.expr(f"cast(floor(cast({window[1]} as decimal(38,2)) * _score / 100) as bigint)")})
    listed = ends.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("rank", "_low", "_high"))).alias("_ends"))

    def side(name: str, unused: int) -> Column:
        """One end of every window; anchors with fewer positives have windows that nothing fits."""
        return F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("_ends", i)[name], F.lit(unused)))

    asking = queries.join(listed, "_id").withColumns({"_least": side("_low", _LAST), "_most": side("_high", NONE + 1)}).drop("_ends")
    near = best(index, asking, total, asked, width, coordinates, False, negatives)
    near = first(near, ["_id", "_window"], negatives).select(
        F.col("_id").alias("anchor_id"), (F.col("_window") + 1).cast("int").alias("_of"), "rank", F.col("_found").alias("negative_id"), F.col("_score").alias("negative_score")
    )
    positive = found.select(F.col("_id").alias("anchor_id"), F.col("rank").alias("_of"), F.col("_found").alias("positive_id"), F.col("_score").alias("positive_score"))
    return near.join(positive, ["anchor_id", "_of"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5"""


@register("op11_hard_negatives", _SQL)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors."""
    rows = read(spark, folder, "embeddings")
    label = F.col("label").cast("long")
    changed = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    named = rows.select("vec_id", changed.alias("label"), quantised(F.col("embedding"), 256).alias("vector"))
    return hard_negatives(named, F.col("vec_id") % 100 == 0)
