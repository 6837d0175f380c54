"""Calculators on frequency and scale: Fourier, Welch and wavelet coefficients."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse.operators.features.common import KEYS, emit, in_time, whole

# Calculator parameters.
FFT_COEFFICIENTS = 100
FFT_ATTRS = ["real", "imag", "abs", "angle"]
FFT_MOMENTS = ["centroid", "variance", "skew", "kurtosis"]
WELCH_COEFFICIENTS = [2, 5, 8]
WELCH_SEGMENT = 256
CWT_WIDTHS = [2, 5, 10, 20]
CWT_COEFFICIENTS = 15
CWT_PEAK_WIDTHS = [1, 5]


def as_arrays(series: DataFrame, keys: list[str], times: bool = False) -> DataFrame:
    """(keys..., x): the values of each series in time order, with ``times`` also their t.

    A series comes from one document, so its array is no larger than the row
    that held the text.
    """
    pairs = F.sort_array(F.collect_list(F.struct("t", "value")))
    sorted_ = series.groupBy(*keys).agg(pairs.alias("_pairs"))
    t = [F.col("_pairs.t").alias("t")] if times else []
    return sorted_.select(*keys, *t, F.col("_pairs.value").alias("x"))


def emit_array(df: DataFrame, keys: list[str], names: list[str], values: Column) -> DataFrame:
    """One row per name from an array of values in the same order (NaN becomes null)."""
    zipped = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("calculator"), values.alias("value"))
    rows = df.select(*keys, F.inline(zipped).alias("calculator", "value"))
    return rows.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def _spectrum(x: np.ndarray) -> np.ndarray:
    f = np.fft.rfft(x)
    size = np.abs(f)
    out = np.full((4, FFT_COEFFICIENTS), np.nan)
    k = min(len(f), FFT_COEFFICIENTS)
    out[:, :k] = [f.real[:k], f.imag[:k], size[:k], np.degrees(np.angle(f[:k]))]
    moments = np.full(4, np.nan)
    total = size.sum()
    if total > 0:
        place = np.arange(len(f), dtype=float)
        m1, m2, m3, m4 = ((size * place**p).sum() / total for p in (1, 2, 3, 4))
        var = m2 - m1 * m1
        moments[:2] = m1, var
        if var >= 0.5:
            moments[2] = (m3 - 3 * m1 * var - m1**3) / var**1.5
            moments[3] = (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1**4) / var**2
    return np.concatenate([out.T.ravel(), moments])


def _welch(x: np.ndarray) -> np.ndarray:
    """Mean periodogram of half-overlapping Hann-windowed segments with their means removed."""
    size = min(WELCH_SEGMENT, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) if size > 1 else np.ones(1)
    step = max(size - size // 2, 1)
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[::step]
    power = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
    density = power.mean(axis=0) / (window**2).sum()
    density[1 : len(density) - (size % 2 == 0)] *= 2
    return np.array([density[c] if c < len(density) else np.nan for c in WELCH_COEFFICIENTS])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def spectrum(x: pd.Series) -> pd.Series:
    """Fourier coefficients, moments of the spectrum and Welch densities of each series."""
    return x.map(lambda v: np.concatenate([_spectrum(v), _welch(v)]))


def fourier_features(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or KEYS
    names = [f"fft_coefficient__coeff_{k}__attr_{a}" for k in range(FFT_COEFFICIENTS) for a in FFT_ATTRS]
    names += [f"fft_aggregated__aggtype_{m}" for m in FFT_MOMENTS]
    names += [f"spkt_welch_density__coeff_{c}" for c in WELCH_COEFFICIENTS]
    return emit_array(as_arrays(series, keys), keys, names, spectrum(F.col("x")))


def _ricker(width: float | Column, place: float | Column) -> Column:
    """Ricker wavelet of a width at a distance from its centre."""
    z = (place / width) * (place / width)
    scale = F.lit(2.0) / (F.sqrt(F.lit(3.0) * width) * F.lit(math.pi**0.25))
    return scale * (1 - z) * F.exp(-z / 2)


def wavelet_features(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The first convolution values with Ricker wavelets of min(10 width, n) points."""
    keys = keys or KEYS
    reach = CWT_COEFFICIENTS + 5 * max(CWT_WIDTHS)
    sized = series.withColumn("n", F.count(F.lit(1)).over(whole(keys))).filter(F.col("t") < reach)
    widths = F.explode(F.array(*[F.lit(w) for w in CWT_WIDTHS]))
    rows = sized.select(*keys, "t", "value", "n", widths.alias("width"))
    points = F.least(F.col("width") * 10, F.col("n"))
    rows = rows.withColumn("points", points).withColumn("centre", F.floor((F.col("points") - 1) / 2))
    sums = []
    for c in range(CWT_COEFFICIENTS):
        i = F.lit(c) + F.col("centre") - F.col("t")
        weight = _ricker(F.col("width").cast("double"), i - (F.col("points") - 1) / 2)
        inside = (i >= 0) & (i < F.col("points")) & (F.col("n") > c)
        sums.append(F.sum(F.when(inside, F.col("value") * weight)).alias(f"c{c}"))
    one = rows.groupBy(*keys, "width").agg(*sums)
    pairs = F.array(*[
        F.struct(
            F.format_string(f"cwt_coefficients__coeff_{c}__w_%d", "width").alias("calculator"),
            F.col(f"c{c}").alias("value"),
        )
        for c in range(CWT_COEFFICIENTS)
    ])
    return one.select(*keys, F.inline(pairs))


def ricker_weights(width: int) -> list[float]:
    points = 10 * width
    place = [i - (points - 1) / 2 for i in range(points)]
    scale = 2.0 / (math.sqrt(3.0 * width) * math.pi**0.25)
    return [scale * (1 - (p / width) ** 2) * math.exp(-((p / width) ** 2) / 2) for p in place]


def wavelet_peak_features(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Places that are local maxima of the wavelet response at every width 1..n (zeros beyond the ends)."""
    keys = keys or KEYS
    t = in_time(keys)
    widths = range(1, max(CWT_PEAK_WIDTHS) + 1)
    back, ahead = 5 * max(widths), 5 * max(widths) - 1
    near = series.select(
        *keys, "t",
        *[F.lag("value", k, 0.0).over(t).alias(f"m{k}") for k in range(back, 0, -1)],
        F.col("value").alias("p0"),
        *[F.lead("value", k, 0.0).over(t).alias(f"p{k}") for k in range(1, ahead + 1)],
    )

    def at(offset: int) -> Column:
        return F.col(f"p{offset}") if offset >= 0 else F.col(f"m{-offset}")

    responses = near.select(*keys, "t", *[
        sum((at(5 * w - 1 - i) * F.lit(c) for i, c in enumerate(ricker_weights(w))), F.lit(0.0)).alias(f"r{w}")
        for w in widths
    ])
    peaks = responses.select(*keys, *[
        ((F.col(f"r{w}") > F.lag(f"r{w}").over(t)) & (F.col(f"r{w}") > F.lead(f"r{w}").over(t))).alias(f"k{w}")
        for w in widths
    ])
    counts = []
    for n in CWT_PEAK_WIDTHS:
        every = F.lit(True)
        for w in range(1, n + 1):
            every = every & F.col(f"k{w}")
        counts.append(F.count_if(every).alias(f"n{n}"))
    one = peaks.groupBy(*keys).agg(*counts)
    return emit(one, keys, [(f"number_cwt_peaks__n_{n}", F.col(f"n{n}")) for n in CWT_PEAK_WIDTHS])
