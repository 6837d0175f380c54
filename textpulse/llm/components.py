"""Connected components of a graph given as an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the least of its neighbours and itself."""
    both = edges.select(F.col("child").alias("u"), F.col("root").alias("v")).unionByName(
        edges.select(F.col("root").alias("u"), F.col("child").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("child"), F.col("m").alias("root"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("child").agg(F.min("root").alias("m"))
    joined = edges.join(least, "child")
    others = joined.filter("root <> m").select(F.col("root").alias("child"), F.col("m").alias("root"))
    return others.unionByName(least.select("child", F.col("m").alias("root")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has an edge to another one; ``root`` is the least node of its component.

    Rounds go on until the edges are stars around their least node; each is stored, so that plans stay short and lost executors cost
    one round at most. Direction, order and repetition of edges do not matter; null ends and loops are left out. An
    empty table has no components.
    """
    edges = edges.filter(F.col(a) != F.col(b))
    # Stored first: a round reads its edges more than once.
    now = written(edges.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("root")), "edges")
    while True:
        now = written(_small_star(_large_star(now)).filter("child <> root").distinct(), "edges")
        if _only_stars(now):
            return now.select(F.col("child").alias("node"), "root").unionByName(
                now.select(F.col("root").alias("node"), "root").distinct()
            )


def _only_stars(edges: DataFrame) -> bool:
    """Whether every child has one root, and no root is a child."""
    ends = edges.select(F.col("child").alias("node"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("root").alias("node"), F.lit(0).alias("up"))
    )
    ups = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n"))
    return ups.filter("ups > 1 or (ups = 1 and n > 1)").isEmpty()
