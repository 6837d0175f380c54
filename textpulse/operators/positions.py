"""Positions and running totals in a total order, without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpulse.session import checkpointed

_ROWS_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _order(order: list[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _sorted_blocks(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Range-partition and sort by ``order``, which must be unique per row.

    Adds ``_block`` (range number) and ``_row`` (position inside it). The rows
    are checkpointed because range bounds are sampled: the block totals and the
    rows joined to them must come from one and the same partitioning.
    """
    keys = _order(order)
    gid = F.monotonically_increasing_id()
    blocks = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_gid", gid)
    return checkpointed(blocks).select(
        "*",
        F.shiftright("_gid", _ROWS_BITS).alias("_block"),
        F.col("_gid").bitwiseAND((1 << _ROWS_BITS) - 1).alias("_row"),
    ).drop("_gid")


def with_position(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """Add the 1-based position of every row in the total order ``order``.

    A window over the whole table would sort it in one task. Here every range
    partition numbers its own rows and adds the sizes of the ranges before it;
    the table of sizes has one row per partition, so broadcasting it is safe.
    """
    blocks = _sorted_blocks(df, order)
    sizes = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        blocks.join(F.broadcast(starts), "_block")
        .withColumn(name, F.col("_before") + F.col("_row") + 1)
        .drop("_block", "_row", "_before")
    )


def with_running_total(
    df: DataFrame, order: list[Column | str], weights: list[str], prefix: str = "cum_"
) -> DataFrame:
    """Add inclusive running totals of ``weights`` along the total order ``order``."""
    blocks = _sorted_blocks(df, order)
    sums = blocks.groupBy("_block").agg(*[F.sum(w).alias(f"_b_{w}") for w in weights])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "_block", *[F.coalesce(F.sum(f"_b_{w}").over(before), F.lit(0)).alias(f"_b_{w}") for w in weights]
    )
    inside = Window.partitionBy("_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.join(F.broadcast(starts), "_block").select(
        "*", *[(F.sum(w).over(inside) + F.col(f"_b_{w}")).alias(prefix + w) for w in weights]
    )
    return out.drop("_block", "_row", *[f"_b_{w}" for w in weights])


def shuffled_position(
    df: DataFrame, groups: list[str], key: str, seed: int = 0, name: str = "position"
) -> DataFrame:
    """Add each row's 1-based position inside its group, in a seeded random order.

    The order is by md5(seed:key). Its first three hex digits cut every group
    into 4096 even slices, so a group holding most rows is still numbered by
    many tasks; the slice sizes are summed over at most 4096 rows per group.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    sliced = hashed.withColumn("_slice", F.substring("_h", 1, 3))
    sizes = sliced.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*groups, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups, "_slice").orderBy("_h", key)
    return (
        sliced.withColumn("_in", F.row_number().over(inside))
        .join(starts, [*groups, "_slice"])
        .withColumn(name, F.col("_before") + F.col("_in"))
        .drop("_h", "_slice", "_in", "_before")
    )
