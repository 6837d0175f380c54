"""Joins of many rows with a table of values per key that leave the rows where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.session import checkpointed

#: Keys that are broadcast at most, the most frequent ones.
COMMON = 100_000


def looked_up(
    rows: DataFrame,
    values: DataFrame,
    on: list[str],
    weight: str,
    how: str = "inner",
    common: int | None = None,
    home: str = "doc_id",
) -> DataFrame:
    """``rows`` joined with ``values``, an inner or a left join on ``on``.

    ``values`` has one row per key, is cheap to read, and tells in ``weight``, which is left out, how often a key is
    asked for. Its ``common`` heaviest keys (COMMON) are broadcast, so that most rows are not shuffled and partial sums per document
    are made in the document's task; only rows of other keys meet their values in a shuffle, and go back to one task for
    each value of ``home``, which holds for them too.
    """
    plain, common = values.drop(weight), COMMON if common is None else common
    if values.count() <= common:
        return rows.join(F.broadcast(plain), on, how)
    often = checkpointed(values.orderBy(F.col(weight).desc(), *on).limit(common).select(*on))
    near = rows.join(F.broadcast(plain.join(F.broadcast(often), on, "left_semi")), on)
    rest = plain.join(F.broadcast(often), on, "left_anti")
    far = rows.join(F.broadcast(often), on, "left_anti").join(rest, on, how)
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return near.unionByName(far.repartition(tasks, home))
