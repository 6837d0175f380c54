"""Shared parts of the feature calculators.

Every calculator takes a long series table (keys..., t, value) with t = 0, 1, ...
and gives (keys..., calculator, value). Windows and groupings are all by the
series keys, so a table already partitioned by document is not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["doc_id", "method"]


def emit(df: DataFrame, keys: list[str], values: list[tuple[str, Column]]) -> DataFrame:
    """Turn one wide row per series into one row per calculator."""
    pairs = F.array(
        *[F.struct(F.lit(name).alias("calculator"), v.cast("double").alias("value")) for name, v in values]
    )
    return df.select(*keys, F.inline(pairs))


def with_name(features: DataFrame, method: str = "method") -> DataFrame:
    """(doc_id, ..., grp, feature, value) with feature = <method>__<calculator>."""
    others = [c for c in features.columns if c not in (method, "calculator", "value")]
    return features.select(
        *others,
        F.col(method).alias("grp"),
        F.concat_ws("__", method, "calculator").alias("feature"),
        "value",
    )


def in_time(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("t")


def whole(keys: list[str]) -> Window:
    return Window.partitionBy(*keys)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def num(x: float) -> str:
    """Parameter value as it appears in a feature name."""
    return repr(round(float(x), 10)) if not float(x).is_integer() else str(int(x))
