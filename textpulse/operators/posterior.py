"""Bayesian estimation of the difference between two groups of fold scores, on a grid.

Model per comparison: group means normal around the pooled mean with twice the
pooled deviation, group deviations uniform, degrees of freedom 1 + Exp(29),
Student t likelihood. Given the degrees of freedom the groups are independent,
so each has its own (mean, deviation) grid and only those meet per value of nu.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpulse.session import checkpointed

# Prior of the model.
SD_LOW, SD_HIGH = 0.01, 0.1
NU_MEAN = 29.0
PRIOR_SPREAD = 2.0


def nu_points(points: int) -> list[tuple[float, float]]:
    """(nu, ln of the t density's constant) at the middle of equally likely slices of the prior."""
    nus = [1.0 - NU_MEAN * math.log1p(-(i + 0.5) / points) for i in range(points)]
    return [(v, math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi)) for v in nus]


def group_scores(pairs: DataFrame) -> DataFrame:
    """(candidate, grp, m, s, ys): both groups of each comparison with the pooled mean and deviation."""
    sides = F.inline(F.array(
        F.struct(F.lit("current").alias("grp"), F.col("current").alias("y")),
        F.struct(F.lit("score").alias("grp"), F.col("score").alias("y")),
    ))
    w = Window.partitionBy("candidate")
    pooled = pairs.select("candidate", sides).select(
        "candidate", "grp", "y", F.avg("y").over(w).alias("m"),
        F.greatest(F.stddev_samp("y").over(w), F.lit(1e-9)).alias("s"),
    )
    return pooled.groupBy("candidate", "grp").agg(
        F.first("m").alias("m"), F.first("s").alias("s"), F.sort_array(F.collect_list("y")).alias("ys"),
        F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("own"),
    )


def group_posterior(pairs: DataFrame, mean_points: int = 201, sd_points: int = 30, nus: int = 10) -> DataFrame:
    """(candidate, grp, nu, i, mu, sd, log_weight): unnormalised log posterior of each grid cell of a group.

    One comparison has a fixed number of cells. A group's means run over its
    scores and six standard errors beyond; both groups use the wider step.
    """
    stats = group_scores(pairs)
    error = F.greatest(F.lit(SD_LOW), F.least(F.lit(SD_HIGH), F.col("own"))) / F.sqrt(F.size("ys"))
    low, high = F.array_min("ys") - error * 6, F.array_max("ys") + error * 6
    ranged = stats.select("*", ((low + high) / 2).alias("middle"), (high - low).alias("width"))
    step = F.max("width").over(Window.partitionBy("candidate")) / (mean_points - 1)
    sized = ranged.withColumn("step", step)
    nu = F.array(*[F.struct(F.lit(v).alias("nu"), F.lit(c).alias("constant")) for v, c in nu_points(nus)])
    cells = (
        sized.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(mean_points - 1))))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(sd_points - 1))))
        .withColumn("p", F.explode(nu))
        .select(
            "candidate", "grp", "m", "s", "ys", "step", "middle", "i", "p.*",
            (F.col("middle") + F.col("step") * (F.col("i") - (mean_points - 1) / 2)).alias("mu"),
            (F.lit(SD_LOW) + F.lit((SD_HIGH - SD_LOW) / sd_points) * (F.col("j") + 0.5)).alias("sd"),
        )
    )
    prior_z = (F.col("mu") - F.col("m")) / (F.lit(PRIOR_SPREAD) * F.col("s"))

    def log_density(y):
        z = (y - F.col("mu")) / F.col("sd")
        return F.col("constant") - F.log("sd") - (F.col("nu") + 1) / 2 * F.log1p(z * z / F.col("nu"))

    likelihood = F.aggregate("ys", F.lit(0.0), lambda total, y: total + log_density(y))
    return cells.select(
        "candidate", "grp", "nu", "i", "mu", "sd", (likelihood - prior_z * prior_z / 2).alias("log_weight")
    )


def _weights(cells: DataFrame, *keys: str) -> DataFrame:
    """Weights summed over everything but ``keys``; the largest cell of a group weighs 1."""
    top = F.max("log_weight").over(Window.partitionBy("candidate", "grp"))
    scaled = cells.withColumn("w", F.exp(F.col("log_weight") - top))
    return scaled.groupBy("candidate", "grp", "nu", *keys).agg(F.sum("w").alias("w"))


def _both(weights: DataFrame, *keys: str) -> DataFrame:
    """The two groups side by side per comparison and nu: grid cells only, never scores."""
    a = weights.filter("grp = 'current'").select("candidate", "nu", *[F.col(k).alias(f"{k}_a") for k in keys], F.col("w").alias("w_a"))
    b = weights.filter("grp = 'score'").select("candidate", "nu", *[F.col(k).alias(f"{k}_b") for k in keys], F.col("w").alias("w_b"))
    return a.join(b, ["candidate", "nu"]).withColumn("w", F.col("w_a") * F.col("w_b"))


def _normalised(rows: DataFrame, quantity: str) -> DataFrame:
    one = rows.groupBy("candidate", "cell").agg(F.avg("x").alias("x"), F.sum("w").alias("w"))
    total = F.sum("w").over(Window.partitionBy("candidate"))
    return one.select("candidate", F.lit(quantity).alias("quantity"), "x", (F.col("w") / total).alias("weight"))


def mean_difference_posterior(cells: DataFrame) -> DataFrame:
    """(candidate, quantity, x, weight): posterior of current mean - candidate mean, weights summing to 1.

    Both grids have one step, so cells i and j always differ by the same amount
    for the same i - j.
    """
    both = _both(_weights(cells, "i", "mu"), "i", "mu")
    return _normalised(
        both.select("candidate", (F.col("i_a") - F.col("i_b")).alias("cell"), (F.col("mu_a") - F.col("mu_b")).alias("x"), "w"),
        "difference of means",
    )


def sd_difference_posterior(cells: DataFrame) -> DataFrame:
    """The same for the difference of the deviations."""
    both = _both(_weights(cells, "sd"), "sd")
    x = F.col("sd_a") - F.col("sd_b")
    return _normalised(both.select("candidate", F.round(x, 9).alias("cell"), x.alias("x"), "w"), "difference of stds")


def effect_size_posterior(cells: DataFrame) -> DataFrame:
    """The same for (difference of means) / rms deviation, over all pairs of cells of the full grid.

    Means have one step, so the pairs of cells with one difference i - j and one pair of deviations have one value:
    their weights are a cross-correlation of two rows of the grid. A comparison is one grid of fixed size.
    """
    weights = _weights(cells, "i", "mu", "sd")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        mu = {g: d.groupby("i")["mu"].first() for g, d in pdf.groupby("grp")}
        step = mu["current"].diff().mean()
        base = mu["current"].iloc[0] - mu["score"].iloc[0]
        sds = np.sort(pdf["sd"].unique())
        points = len(mu["current"])
        total: dict[tuple[int, int], np.ndarray] = {}
        for _, part in pdf.groupby("nu"):
            grid = {}
            for g, d in part.groupby("grp"):
                grid[g] = np.zeros((len(sds), points))
                grid[g][np.searchsorted(sds, d["sd"]), d["i"]] = d["w"]
            for a in range(len(sds)):
                for b in range(len(sds)):
                    pair = (min(a, b), max(a, b))
                    w = np.correlate(grid["current"][a], grid["score"][b], "full")
                    total[pair] = total[pair] + w if pair in total else w
        x = np.concatenate([(base + step * np.arange(1 - points, points)) / np.sqrt((sds[a] ** 2 + sds[b] ** 2) / 2) for a, b in total])
        w = np.concatenate(list(total.values()))
        return pd.DataFrame({"candidate": pdf["candidate"].iloc[0], "quantity": "effect size", "x": x, "weight": w / w.sum()})

    schema = "candidate string, quantity string, x double, weight double"
    return weights.groupBy("candidate").applyInPandas(one, schema)


def posterior(pairs: DataFrame) -> DataFrame:
    """All three derived quantities of every comparison."""
    cells = checkpointed(group_posterior(pairs))
    return (
        mean_difference_posterior(cells)
        .unionByName(sd_difference_posterior(cells))
        .unionByName(effect_size_posterior(cells))
    )


def posterior_summary(posterior: DataFrame, fdr_level: float = 0.05) -> DataFrame:
    """(candidate, quantity, mean, low, high): mean and the 50*level and 100-50*level percentiles."""
    w = Window.partitionBy("candidate", "quantity").orderBy("x")
    running = posterior.withColumn("cum", F.sum("weight").over(w))
    return running.groupBy("candidate", "quantity").agg(
        F.sum(F.col("x") * F.col("weight")).alias("mean"),
        F.min(F.when(F.col("cum") >= fdr_level / 2, F.col("x"))).alias("low"),
        F.min(F.when(F.col("cum") >= 1 - fdr_level / 2 - 1e-12, F.col("x"))).alias("high"),
    )


def significance(
    summary: DataFrame, tests: DataFrame, greater_is_better: bool = False, wilcoxon_level: float = 0.05
) -> DataFrame:
    """Add ``significant``: the signed-rank test passes and the interval excludes 0 on the improving side."""
    means = summary.filter("quantity = 'difference of means'")
    better = (F.col("high") < 0) if greater_is_better else (F.col("low") > 0)
    joined = means.join(tests.select("candidate", "p_value"), "candidate")
    return joined.withColumn("significant", better & (F.col("p_value") <= wilcoxon_level))


def next_group(decided: DataFrame, significant_only: bool = False) -> DataFrame:
    """One row: the candidate with the largest absolute mean difference, null if none is significant.

    As long as one candidate is significant all of them compete, unless
    ``significant_only`` keeps the significant ones.
    """
    size = F.abs("mean")
    if significant_only:
        size = F.when(F.col("significant"), size)
    best = F.max_by("candidate", size)
    return decided.agg(F.when(F.bool_or("significant"), best).alias("candidate"))
