"""Stratified folds and splits, scores, and the tests on fold scores."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpulse.functions.tails import normal_two_sided_p
from textpulse.operators.positions import shuffled_position

TINY = 1e-15
#: Rows that a task spreads over the folds, about.
TASK_ROWS = 4_000


def stratified_folds(docs: DataFrame, k: int = 10, seed: int = 0) -> DataFrame:
    """(doc_id, label, fold): folds 0..k-1 whose class sizes differ by at most one row."""
    placed = shuffled_position(docs.select("doc_id", "label"), ["label"], "doc_id", seed)
    return placed.select("doc_id", "label", ((F.col("position") - 1) % k).cast("int").alias("fold"))


def check_fold_count(k: int) -> int:
    """Fold tests need at least five scores."""
    if k < 5:
        raise ValueError("at least 5 folds are needed for the tests on fold scores")
    return k


def train_test_split(docs: DataFrame, test_share: float = 0.33, seed: int = 0) -> DataFrame:
    """(doc_id, label, split): the first ceil(share * size) documents of each shuffled class are test."""
    placed = shuffled_position(docs.select("doc_id", "label"), ["label"], "doc_id", seed)
    sizes = docs.groupBy("label").agg(F.count(F.lit(1)).alias("_size"))
    is_test = F.col("position") <= F.ceil(F.lit(test_share) * F.col("_size"))
    split = F.when(is_test, F.lit("test")).otherwise(F.lit("train"))
    return placed.join(F.broadcast(sizes), "label").select("doc_id", "label", split.alias("split"))


def fold_train_test(rows: DataFrame, folds: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """The training and the test rows of one fold."""
    placed = rows.join(folds.select("doc_id", "fold"), "doc_id")
    return (
        placed.filter(F.col("fold") != fold).drop("fold"),
        placed.filter(F.col("fold") == fold).drop("fold"),
    )


def every_fold(rows: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """Each row once per fold with its ``split`` there: k times the rows, for jobs that need all folds at once.

    The rows of a document are in one of as many tasks as the number of rows asks for. AQE would choose the tasks by the
    rows before they are spread.
    """
    spark = rows.sparkSession
    session = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tasks = max(session, math.ceil(rows.count() / TASK_ROWS))
    placed = rows.repartition(tasks, "doc_id").join(folds.select("doc_id", F.col("fold").alias("_own")).hint("shuffle_hash"), "doc_id")
    spread = placed.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(k)])))
    split = F.when(F.col("fold") == F.col("_own"), F.lit("test")).otherwise(F.lit("train"))
    return spread.withColumn("split", split).drop("_own")


def log_loss(label: str = "label") -> Column:
    """Mean negative log probability of the true class.

    Rows of other classes count for nothing, so one row per document and class will do as well as one per document.
    """
    p = F.greatest(F.least(F.col("proba"), F.lit(1 - TINY)), F.lit(TINY))
    return -F.avg(F.when(F.col("class") == F.col(label), F.log(p)))


def accuracy(label: str = "label") -> Column:
    """Share of right predictions (one row per document with its predicted class ``y``)."""
    return F.avg((F.col("y") == F.col(label)).cast("double"))


def class_f1(name: str, label: str = "label") -> Column:
    """F1 of one class (one row per document with ``y``); 0 if it is neither given nor true."""
    given, true = F.col("y") == name, F.col(label) == name
    count = lambda c: F.coalesce(F.sum(c.cast("double")), F.lit(0.0))
    return F.coalesce(F.try_divide(2 * count(given & true), count(given) + count(true)), F.lit(0.0))


def macro_f1(classes: list[str]) -> Callable[[], Column]:
    """Metric: the mean F1 of the classes."""
    return lambda: sum((class_f1(c) for c in classes[1:]), class_f1(classes[0])) / len(classes)


def most_likely(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., y): the class with the largest probability (ties: the smaller name)."""
    best = F.min(F.struct((-F.col("proba")).alias("p"), F.col("class")))["class"]
    return predictions.groupBy(*keys).agg(best.alias("y"))


def f1_scores(predicted: DataFrame, label: str = "label") -> DataFrame:
    """(class, precision, recall, f1) from one row per document with ``label`` and ``y``."""
    sides = predicted.select(
        F.explode(F.array(
            F.struct(F.col(label).alias("class"), (F.col("y") == F.col(label)).cast("int").alias("hit"),
                     F.lit(0).alias("given"), F.lit(1).alias("true")),
            F.struct(F.col("y").alias("class"), F.lit(0).alias("hit"), F.lit(1).alias("given"), F.lit(0).alias("true")),
        )).alias("s")
    ).select("s.*")
    one = sides.groupBy("class").agg(F.sum("hit").alias("hit"), F.sum("given").alias("given"), F.sum("true").alias("true"))
    precision = F.coalesce(F.try_divide(F.col("hit"), F.col("given")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hit"), F.col("true")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.col("hit") * 2.0, F.col("given") + F.col("true")), F.lit(0.0))
    return one.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def score_table(predictions: DataFrame, labels: DataFrame, metric: Callable[[], Column] = log_loss) -> DataFrame:
    """(method, fold, train, test): the metric per fold and side.

    ``predictions`` is (doc_id, method, fold, split, class, proba). A metric
    aggregates one row per document with its ``label``, the predicted class
    ``y``, and the true class as ``class`` with its ``proba``.
    """
    # A task's hash table holds its labels; the predictions, many a document, pass by it unsorted.
    scored = predictions.join(labels.select("doc_id", "label").hint("shuffle_hash"), "doc_id")
    best = F.min(F.struct((-F.col("proba")).alias("p"), F.col("class")))["class"]
    true = F.max(F.when(F.col("class") == F.col("label"), F.col("proba")))
    one_each = scored.groupBy("method", "fold", "split", "doc_id", "label").agg(best.alias("y"), true.alias("proba"))
    one_each = one_each.withColumn("class", F.col("label"))
    sides = one_each.groupBy("method", "fold", "split").agg(metric().alias("score"))
    one = {s: F.max(F.when(F.col("split") == s, F.col("score"))).alias(s) for s in ("train", "test")}
    return sides.groupBy("method", "fold").agg(one["train"], one["test"])


def paired_scores(scores: DataFrame, current: str, candidates: list[str] | None = None) -> DataFrame:
    """(candidate, fold, current, score): test scores of each candidate next to those of ``current``."""
    base = scores.filter(F.col("method") == current).select("fold", F.col("test").alias("current"))
    others = scores.filter(F.col("method") != current)
    if candidates is not None:
        others = others.filter(F.col("method").isin(candidates))
    return others.join(base, "fold").select(F.col("method").alias("candidate"), "fold", "current", F.col("test").alias("score"))


def wilcoxon(pairs: DataFrame, with_p: bool = True) -> DataFrame:
    """(candidate, n, t, z[, p_value]): signed-rank test of ``current`` against ``score``.

    Zero differences are left out; ranks of ties are averaged and the variance
    corrected. One row per fold and candidate goes in, so groups hold k rows.
    """
    d = pairs.select("candidate", (F.col("current") - F.col("score")).alias("d")).filter("d <> 0")
    d = d.withColumn("size", F.round(F.abs("d"), 12))
    by_size = Window.partitionBy("candidate").orderBy("size")
    same = Window.partitionBy("candidate", "size")
    ties = F.count(F.lit(1)).over(same)
    ranked = d.select("candidate", "d", (F.rank().over(by_size) + (ties - 1) / 2).alias("rank"), ties.alias("ties"))
    one = ranked.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("n"),
        F.least(
            F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)),
            F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)),
        ).alias("t"),
        F.sum(F.col("ties") * F.col("ties") - 1).alias("tie_sum"),
    )
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_sum") / 48
    z = F.try_divide(F.col("t") - n * (n + 1) / 4, F.sqrt(var))
    out = pairs.select("candidate").distinct().join(one.withColumn("z", z), "candidate", "left").select(
        "candidate", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("t", F.lit(0.0)).alias("t"), "z"
    )
    return out.withColumn("p_value", F.coalesce(normal_two_sided_p("z"), F.lit(1.0))) if with_p else out
