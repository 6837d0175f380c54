"""Feature calculators over the token length series (and the length distribution) of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpulse.functions import text as tx
from textpulse.operators import mappers as mp
from textpulse.operators.features import aggregate as ag
from textpulse.operators.features import change as ch
from textpulse.operators.features import entropy as en
from textpulse.operators.features import extract as ex
from textpulse.operators.features import model as mo
from textpulse.operators.features import shape as sh
from textpulse.operators.features import spectral as sp
from textpulse.operators.features.common import KEYS, num
from textpulse.queries.registry import (
    SQL_LENGTH_SHARES,
    SQL_SERIES,
    SQL_TOKENS,
    documents,
    r6,
    register,
    rounded,
    sql_r6,
    table,
)
from textpulse.session import checkpointed, stored


def lengths(spark, folder):
    return mp.TokenLengthSequence(tokenizer=tx.word_marks).transform(documents(spark, folder))


def shares(spark, folder):
    return mp.TokenLengthDistribution(tokenizer=tx.word_marks).transform(documents(spark, folder))


def long_form(values):
    return values.select("doc_id", "calculator", r6("value").alias("value"))


def unpivot(select: str, names: list[tuple[str, str]], tail: str) -> str:
    """SELECT the named expressions and turn them into (doc_id, calculator, value) rows."""
    columns = ", ".join(f"CAST({e} AS DOUBLE) AS \"{n}\"" for n, e in names)
    return f"""{select} wide AS (SELECT doc_id, {columns} {tail}),
    long AS (SELECT * FROM wide UNPIVOT INCLUDE NULLS (value FOR calculator IN (COLUMNS(* EXCLUDE doc_id))))
    SELECT doc_id, calculator, {sql_r6('value')} AS value FROM long"""


BASE = f"WITH {SQL_TOKENS}, {SQL_SERIES}"
STATS = """st AS (SELECT doc_id, count(*) AS n, sum(value) / count(*) AS mu, min(value) AS lo, max(value) AS hi,
  sum(abs(value)) AS mass FROM s GROUP BY doc_id),
d0 AS (SELECT s.doc_id, t, value, n, mu, lo, hi, mass, value - mu AS dev FROM s JOIN st USING (doc_id)),
sds AS (SELECT doc_id, sqrt(sum(dev * dev) / any_value(n)) AS sd FROM d0 GROUP BY doc_id),
d AS (SELECT d0.*, sd FROM d0 JOIN sds USING (doc_id))"""


def _aggregate_sql() -> str:
    q = "quantile_cont(value, {})".format
    n = "any_value(n)"
    names = [
        ("length", "count(*)"), ("sum_values", "sum(value)"), ("mean", "any_value(mu)"), ("minimum", "min(value)"),
        ("maximum", "max(value)"), ("median", "median(value)"),
        *[(f"quantile__q_{num(x)}", q(x)) for x in ag.QUANTILES],
        ("variance", "any_value(sd) * any_value(sd)"), ("standard_deviation", "any_value(sd)"),
        ("skewness", f"CASE WHEN {n} > 2 AND any_value(sd) > 0 THEN avg(dev ** 3) / any_value(sd) ** 3 * sqrt({n} * ({n} - 1)) / ({n} - 2) END"),
        ("kurtosis", f"CASE WHEN {n} > 3 AND any_value(sd) > 0 THEN (({n} + 1) * (avg(dev ** 4) / any_value(sd) ** 4 - 3) + 6) * ({n} - 1) / (({n} - 2) * ({n} - 3)) END"),
        ("abs_energy", "sum(value * value)"),
        ("variance_larger_than_standard_deviation", "any_value(sd) * any_value(sd) > any_value(sd)"),
        *[(f"large_standard_deviation__r_{num(r)}", f"any_value(sd) > (max(value) - min(value)) * {r}") for r in ag.SPREAD_SHARES],
        *[(f"symmetry_looking__r_{num(r)}", f"abs(any_value(mu) - median(value)) < (max(value) - min(value)) * {r}") for r in ag.SYMMETRY_SHARES],
        ("value_count__value_0", "count(*) FILTER (value = 0)"), ("value_count__value_1", "count(*) FILTER (value = 1)"),
        *[(f"range_count__min_{num(a)}__max_{num(b)}", f"count(*) FILTER (value >= {a} AND value < {b})") for a, b in ag.RANGES],
        ("count_above_mean", "count(*) FILTER (value > mu)"), ("count_below_mean", "count(*) FILTER (value < mu)"),
        *[(f"ratio_beyond_r_sigma__r_{num(r)}", f"count(*) FILTER (abs(value - mu) > {r} * sd) / {n}") for r in ag.SIGMAS],
        ("has_duplicate", "count(DISTINCT value) < count(*)"),
        ("has_duplicate_max", "count(*) FILTER (value = hi) > 1"), ("has_duplicate_min", "count(*) FILTER (value = lo) > 1"),
        ("ratio_value_number_to_time_series_length", "count(DISTINCT value) / count(*)"),
        ("percentage_of_reoccurring_datapoints_to_all_datapoints", "count(DISTINCT CASE WHEN c > 1 THEN value END) / count(DISTINCT value)"),
        ("percentage_of_reoccurring_values_to_all_values", "count(*) FILTER (c > 1) / count(*)"),
        ("sum_of_reoccurring_values", "coalesce(sum(value) FILTER (c > 1 AND i = 1), 0)"),
        ("sum_of_reoccurring_data_points", "coalesce(sum(value) FILTER (c > 1), 0)"),
        ("binned_entropy__max_bins_10", "any_value(entropy)"),
        ("first_location_of_maximum", f"min(t) FILTER (value = hi) / {n}"), ("last_location_of_maximum", f"(max(t) FILTER (value = hi) + 1) / {n}"),
        ("first_location_of_minimum", f"min(t) FILTER (value = lo) / {n}"), ("last_location_of_minimum", f"(max(t) FILTER (value = lo) + 1) / {n}"),
    ]
    return unpivot(
        f"""{BASE}, {STATS},
        b AS (SELECT doc_id, CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / 10)), 9) ELSE 0 END AS bin,
              count(*) / any_value(n) AS p FROM d GROUP BY 1, 2),
        e AS (SELECT doc_id, sum(-p * ln(p)) AS entropy FROM b GROUP BY doc_id),
        dd AS (SELECT d.*, entropy, count(*) OVER (PARTITION BY d.doc_id, value) AS c,
               row_number() OVER (PARTITION BY d.doc_id, value ORDER BY t) AS i FROM d JOIN e USING (doc_id)),""",
        names,
        "FROM dd GROUP BY doc_id",
    )


@register("feature_aggregates", _aggregate_sql())
def feature_aggregates(spark, folder):
    return long_form(ag.aggregate_features(lengths(spark, folder)))


def _leads(column: str, prefix: str, upto: int) -> str:
    return ", ".join(f"lead({column}, {k}) OVER w AS {prefix}{k}" for k in range(1, upto + 1))


def _change_sql() -> str:
    acfs = ", ".join(
        f"CASE WHEN v > 1e-12 AND n > {k} THEN a{k} / ((n - {k}) * v) END AS r{k}" for k in range(0, ch.MAX_LAG + 1)
    )
    lagged = [f"r{k}" for k in range(1, ch.MAX_LAG + 1)]
    listed = f"list_filter([{', '.join(lagged)}], lambda x: x IS NOT NULL)"
    names = [
        ("mean_change", "mc"), ("mean_abs_change", "mac"), ("absolute_sum_of_changes", "coalesce(asc_, 0)"),
        ("mean_second_derivative_central", "m2"), ("cid_ce__normalize_False", "sqrt(coalesce(sq, 0))"),
        ("cid_ce__normalize_True", "CASE WHEN v > 1e-12 THEN sqrt(coalesce(sq, 0)) / sqrt(v) ELSE 0 END"),
        *[(f"c3__lag_{k}", f"coalesce(c{k}, 0)") for k in ch.C3_LAGS],
        *[(f"time_reversal_asymmetry_statistic__lag_{k}", f"coalesce(q{k}, 0)") for k in ch.C3_LAGS],
        *[(f"autocorrelation__lag_{k}", f"r{k}") for k in ch.AUTOCORRELATION_LAGS],
        ("agg_autocorrelation__f_agg_mean__maxlag_40", f"list_avg({listed})"),
        ("agg_autocorrelation__f_agg_median__maxlag_40", f"list_median({listed})"),
        ("agg_autocorrelation__f_agg_var__maxlag_40", f"list_var_pop({listed})"),
    ]
    return unpivot(
        f"""{BASE}, {STATS},
        l AS (SELECT doc_id, n, value, dev, {_leads('value', 'x', 6)}, {_leads('dev', 'd', ch.MAX_LAG)}
              FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY t)),
        o AS (SELECT doc_id, any_value(n) AS n, avg(x1 - value) AS mc, avg(abs(x1 - value)) AS mac,
              sum(abs(x1 - value)) AS asc_, avg((x2 - 2 * x1 + value) / 2) AS m2, sum((x1 - value) ** 2) AS sq,
              {', '.join(f'avg(x{2 * k} * x{k} * value) AS c{k}' for k in ch.C3_LAGS)},
              {', '.join(f'avg(x{2 * k} * x{2 * k} * x{k} - x{k} * value * value) AS q{k}' for k in ch.C3_LAGS)},
              sum(dev * dev) AS a0, sum(dev * dev) / any_value(n) AS v,
              {', '.join(f'sum(dev * d{k}) AS a{k}' for k in range(1, ch.MAX_LAG + 1))} FROM l GROUP BY doc_id),
        r AS (SELECT *, {acfs} FROM o),""",
        names,
        "FROM r",
    )


@register("feature_changes", _change_sql())
def feature_changes(spark, folder):
    return long_form(ch.change_features(lengths(spark, folder)))


def _corridor_sql() -> str:
    grid = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    names = []
    for i in range(5):
        for j in range(i + 1, 6):
            inside = f"FILTER (value BETWEEN q[{i + 1}] AND q[{j + 1}] AND nx BETWEEN q[{i + 1}] AND q[{j + 1}])"
            for isabs, x in (("False", "nx - value"), ("True", "abs(nx - value)")):
                head = f"change_quantiles__ql_{num(grid[i])}__qh_{num(grid[j])}__isabs_{isabs}__f_agg_"
                names.append((head + "mean", f"coalesce(avg({x}) {inside}, 0)"))
                names.append((head + "var", f"coalesce(var_pop({x}) {inside}, 0)"))
    return unpivot(
        f"""{BASE},
        q AS (SELECT doc_id, [{', '.join(f'quantile_cont(value, {g})' for g in grid)}] AS q FROM s GROUP BY doc_id),
        l AS (SELECT s.doc_id, value, q, lead(value) OVER (PARTITION BY s.doc_id ORDER BY t) AS nx
              FROM s JOIN q USING (doc_id)),""",
        names,
        "FROM l GROUP BY doc_id",
    )


@register("feature_corridors", _corridor_sql())
def feature_corridors(spark, folder):
    return long_form(ch.corridor_features(lengths(spark, folder)))


def _shape_sql() -> str:
    peaks = ", ".join(
        f"""(t >= {k} AND t < n - {k} AND value > max(value) OVER (w ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)
        AND value > max(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)) AS peak{k}"""
        for k in sh.PEAK_SUPPORT
    )
    strike = """(SELECT doc_id, max(c) AS {0} FROM (SELECT doc_id, g, count(*) AS c FROM (
        SELECT doc_id, t - row_number() OVER (PARTITION BY doc_id ORDER BY t) AS g FROM d WHERE value {1} mu)
        GROUP BY 1, 2) GROUP BY doc_id)"""
    names = [
        *[(f"index_mass_quantile__q_{num(q)}",
           f"CASE WHEN any_value(mass) > 0 THEN (min(t) FILTER (run >= mass * {q}) + 1) / any_value(n) END") for q in sh.MASS_SHARES],
        ("longest_strike_above_mean", "coalesce(any_value(up), 0)"),
        ("longest_strike_below_mean", "coalesce(any_value(down), 0)"),
        *[(f"number_crossing_m__m_{m}", f"count(*) FILTER ((value > {m}) <> (nx > {m}))") for m in sh.CROSSINGS],
        *[(f"number_peaks__n_{k}", f"count(*) FILTER (peak{k})") for k in sh.PEAK_SUPPORT],
        *[(f"energy_ratio_by_chunks__num_segments_10__segment_focus_{i}",
           f"coalesce(sum(value * value) FILTER (seg = {i}), 0) / nullif(sum(value * value), 0)") for i in range(sh.SEGMENTS)],
    ]
    return unpivot(
        f"""{BASE}, {STATS},
        l AS (SELECT d.doc_id, t, value, n, mass, up, down, lead(value) OVER w AS nx,
              sum(abs(value)) OVER (w ROWS UNBOUNDED PRECEDING) AS run, {peaks},
              CASE WHEN t < (n % 10) * (n // 10 + 1) THEN t // (n // 10 + 1)
                   ELSE n % 10 + (t - (n % 10) * (n // 10 + 1)) // (n // 10) END AS seg
              FROM d LEFT JOIN {strike.format('up', '>')} a ON a.doc_id = d.doc_id
              LEFT JOIN {strike.format('down', '<')} b ON b.doc_id = d.doc_id
              WINDOW w AS (PARTITION BY d.doc_id ORDER BY t)),""",
        names,
        "FROM l GROUP BY doc_id",
    )


@register("feature_shapes", _shape_sql())
def feature_shapes(spark, folder):
    return long_form(sh.shape_features(lengths(spark, folder)))


_LINE = """regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx, avg(y) AS my, count(y) AS m"""
_FIT = {
    "slope": "sxy / nullif(sxx, 0)",
    "intercept": "my - sxy / nullif(sxx, 0) * mx",
    "rvalue": "CASE WHEN sxx > 0 AND syy > 0 THEN sxy / sqrt(sxx * syy) WHEN sxx > 0 THEN 0 END",
    "stderr": "CASE WHEN m > 2 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0) / (m - 2) / sxx) END",
}


@register(
    "feature_linear_trend",
    unpivot(
        f"{BASE}, o AS (SELECT doc_id, {_LINE} FROM (SELECT doc_id, t AS x, value AS y FROM s) GROUP BY doc_id),",
        [(f"linear_trend__attr_{k}", e) for k, e in _FIT.items()],
        "FROM o",
    ),
)
def feature_linear_trend(spark, folder):
    return long_form(sh.trend_features(lengths(spark, folder), with_p=False))


@register("feature_linear_trend_with_p")
def feature_linear_trend_with_p(spark, folder):
    return long_form(sh.trend_features(lengths(spark, folder)))


@register(
    "feature_chunk_trends",
    f"""{BASE}, ch AS (SELECT doc_id, size, t // size AS x, max(value) AS mx_, min(value) AS mn_, avg(value) AS av_,
      var_pop(value) AS va_ FROM s CROSS JOIN (SELECT unnest([5, 10, 50]) AS size) GROUP BY 1, 2, 3),
    y AS (SELECT doc_id, size, x, unnest(['max', 'min', 'mean', 'var']) AS kind, unnest([mx_, mn_, av_, va_]) AS y FROM ch),
    o AS (SELECT doc_id, size, kind, {_LINE} FROM y GROUP BY 1, 2, 3),
    f AS (SELECT doc_id, size, kind, unnest(['slope', 'intercept', 'rvalue', 'stderr']) AS attr,
      unnest([{', '.join(_FIT[k] for k in ('slope', 'intercept', 'rvalue', 'stderr'))}]) AS value FROM o)
    SELECT doc_id, 'agg_linear_trend__f_agg_' || kind || '__chunk_len_' || size || '__attr_' || attr AS calculator,
      {sql_r6('value')} AS value FROM f""",
)
def feature_chunk_trends(spark, folder):
    return long_form(sh.chunk_trend_features(lengths(spark, folder)))


_DFT = """dft AS (SELECT doc_id, k, any_value(n) AS n, sum(value * cos(2 * pi() * k * t / n)) AS re,
    -sum(value * sin(2 * pi() * k * t / n)) AS im FROM d0 CROSS JOIN (SELECT unnest(range(0, {ks})) AS k)
    WHERE k <= n // 2 GROUP BY 1, 2)"""


@register(
    "feature_fourier_coefficients",
    f"""{BASE}, {STATS}, {_DFT.format(ks=sp.FFT_COEFFICIENTS)},
    every AS (SELECT doc_id, k FROM documents CROSS JOIN (SELECT unnest(range(0, {sp.FFT_COEFFICIENTS})) AS k)),
    f AS (SELECT doc_id, k, unnest(['real', 'imag', 'abs']) AS attr, unnest([re, im, sqrt(re * re + im * im)]) AS value
      FROM every LEFT JOIN dft USING (doc_id, k))
    SELECT doc_id, 'fft_coefficient__coeff_' || k || '__attr_' || attr AS calculator, {sql_r6('value')} AS value FROM f""",
)
def feature_fourier_coefficients(spark, folder):
    """Real, imaginary and absolute parts; the angle of a vanishing coefficient is not defined."""
    values = sp.fourier_features(lengths(spark, folder))
    kept = F.col("calculator").startswith("fft_coefficient") & ~F.col("calculator").endswith("angle")
    return long_form(values.filter(kept))


@register("feature_fourier_all")
def feature_fourier_all(spark, folder):
    return long_form(sp.fourier_features(lengths(spark, folder)))


def _spectrum_moments_sql() -> str:
    names = [
        ("fft_aggregated__aggtype_centroid", "m1"), ("fft_aggregated__aggtype_variance", "v"),
        ("fft_aggregated__aggtype_skew", "CASE WHEN v >= 0.5 THEN (m3 - 3 * m1 * v - m1 ** 3) / v ** 1.5 END"),
        ("fft_aggregated__aggtype_kurtosis",
         "CASE WHEN v >= 0.5 THEN (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 ** 4) / v ** 2 END"),
        *[(f"spkt_welch_density__coeff_{c}", f"w{c}") for c in sp.WELCH_COEFFICIENTS],
    ]
    # Series of 14 points: one Welch segment with a 14-point periodic Hann window.
    hann = "(0.5 - 0.5 * cos(2 * pi() * t / 14))"
    welch = ", ".join(
        f"""CASE WHEN {c} <= 7 THEN (CASE WHEN {c} = 7 THEN 1 ELSE 2 END) * (
        sum(dev * {hann} * cos(2 * pi() * {c} * t / 14)) ** 2 + sum(dev * {hann} * sin(2 * pi() * {c} * t / 14)) ** 2)
        / sum({hann} ** 2) END AS w{c}"""
        for c in sp.WELCH_COEFFICIENTS
    )
    return unpivot(
        f"""WITH {SQL_TOKENS}, {SQL_LENGTH_SHARES}, {STATS}, {_DFT.format(ks=8)},
        a AS (SELECT doc_id, k, sqrt(re * re + im * im) AS y FROM dft),
        m AS (SELECT doc_id, {', '.join(f'sum(y * k ** {p}) / nullif(sum(y), 0) AS m{p}' for p in (1, 2, 3, 4))}
              FROM a GROUP BY doc_id),
        w AS (SELECT doc_id, {welch} FROM d0 GROUP BY doc_id),
        x AS (SELECT m.*, m2 - m1 * m1 AS v, w.* EXCLUDE doc_id FROM m JOIN w USING (doc_id)),""",
        names,
        "FROM x",
    )


@register("feature_spectrum_moments", _spectrum_moments_sql())
def feature_spectrum_moments(spark, folder):
    values = sp.fourier_features(shares(spark, folder))
    return long_form(values.filter(~F.col("calculator").startswith("fft_coefficient")))


def _ricker_sql(width: str, place: str) -> str:
    z = f"(({place}) / ({width})) ** 2"
    return f"(2 / (sqrt(3.0 * ({width})) * pi() ** 0.25) * (1 - {z}) * exp(-({z}) / 2))"


@register(
    "feature_wavelets",
    f"""{BASE}, {STATS}, g AS (SELECT unnest([2, 5, 10, 20]) AS width),
    c AS (SELECT unnest(range(0, {sp.CWT_COEFFICIENTS})) AS coeff),
    k AS (SELECT doc_id, width, coeff, n, value, least(10 * width, n) AS points,
      coeff + (least(10 * width, n) - 1) // 2 - t AS i FROM d0, g, c WHERE t < 120),
    o AS (SELECT doc_id, width, coeff, sum(value * {_ricker_sql('width', 'i - (points - 1) / 2')})
      FILTER (i >= 0 AND i < points AND n > coeff) AS value FROM k GROUP BY 1, 2, 3)
    SELECT doc_id, 'cwt_coefficients__coeff_' || coeff || '__w_' || width AS calculator, {sql_r6('value')} AS value FROM o""",
)
def feature_wavelets(spark, folder):
    return long_form(sp.wavelet_features(lengths(spark, folder)))


def _wavelet_peaks_sql() -> str:
    responses = []
    for w in range(1, 6):
        terms = []
        for i, c in enumerate(sp.ricker_weights(w)):
            k = 5 * w - 1 - i
            at = f"lead(value, {k}, 0.0) OVER w" if k > 0 else f"lag(value, {-k}, 0.0) OVER w" if k < 0 else "value"
            terms.append(f"{at} * {c!r}::DOUBLE")
        responses.append(" + ".join(terms) + f" AS r{w}")
    tops = ", ".join(f"r{w} > lag(r{w}) OVER w AND r{w} > lead(r{w}) OVER w AS k{w}" for w in range(1, 6))
    return unpivot(
        f"""{BASE}, r AS (SELECT doc_id, t, {', '.join(responses)} FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY t)),
        k AS (SELECT doc_id, {tops} FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY t)),""",
        [
            ("number_cwt_peaks__n_1", "count(*) FILTER (k1)"),
            ("number_cwt_peaks__n_5", "count(*) FILTER (k1 AND k2 AND k3 AND k4 AND k5)"),
        ],
        "FROM k GROUP BY doc_id",
    )


@register("feature_wavelet_peaks", _wavelet_peaks_sql())
def feature_wavelet_peaks(spark, folder):
    return long_form(sp.wavelet_peak_features(lengths(spark, folder)))


def _partial_sql() -> str:
    steps = ["p0 AS (SELECT doc_id, n, ok, " + ", ".join(f"g{k}" for k in range(10)) + ", g0 AS e FROM g)"]
    for k in range(1, 10):
        known = "".join(f" - f{k - 1}_{j} * g{k - j}" for j in range(1, k))
        phis = "".join(f", f{k - 1}_{j} - last * f{k - 1}_{k - j} AS f{k}_{j}" for j in range(1, k))
        steps.append(
            f"q{k} AS (SELECT *, (g{k}{known}) / nullif(e, 0) AS last FROM p{k - 1}), "
            f"p{k} AS (SELECT * EXCLUDE (e, last), last AS f{k}_{k}{phis}, e * (1 - last ** 2) AS e FROM q{k})"
        )
    sums = ", ".join(
        f"CASE WHEN any_value(n) > {k} THEN sum(dev * {f'd{k}' if k else 'dev'}) / (any_value(n) - {k}) END AS g{k}"
        for k in range(10)
    )
    return unpivot(
        f"""{BASE}, {STATS},
        l AS (SELECT doc_id, n, dev, {_leads('dev', 'd', 9)} FROM d0 WINDOW w AS (PARTITION BY doc_id ORDER BY t)),
        g0 AS (SELECT doc_id, any_value(n) AS n, {sums} FROM l GROUP BY doc_id),
        g AS (SELECT *, n > 1 AND g0 > 1e-12 AS ok FROM g0), {', '.join(steps)},""",
        [("partial_autocorrelation__lag_0", "CASE WHEN ok THEN 1 END")]
        + [(f"partial_autocorrelation__lag_{k}", f"CASE WHEN ok THEN f{k}_{k} END") for k in range(1, 10)],
        "FROM p9",
    )


@register("feature_partial_autocorrelation", _partial_sql())
def feature_partial_autocorrelation(spark, folder):
    return long_form(mo.partial_autocorrelation_features(lengths(spark, folder)))


@register("feature_autoregression")
def feature_autoregression(spark, folder):
    return long_form(mo.autoregression_features(lengths(spark, folder)))


@register(
    "feature_unit_root",
    f"""{BASE}, p AS (SELECT doc_id, value AS x, lead(value) OVER (PARTITION BY doc_id ORDER BY t) - value AS y FROM s),
    o AS (SELECT doc_id, count(*) AS m, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy
      FROM p WHERE y IS NOT NULL GROUP BY doc_id),
    v AS (SELECT *, greatest(syy - sxy * sxy / nullif(sxx, 0), 0) AS rest FROM o)
    SELECT d.doc_id, 'augmented_dickey_fuller__attr_teststat' AS calculator,
      {sql_r6('CASE WHEN rest > 1e-10 * syy AND m > 2 THEN sxy / sxx / sqrt(rest / ((m - 2) * sxx)) END')} AS value
    FROM documents d LEFT JOIN v USING (doc_id)""",
)
def feature_unit_root(spark, folder):
    return long_form(mo.unit_root_features(lengths(spark, folder)))


@register(
    "feature_drift_bins",
    f"""{BASE}, p AS (SELECT doc_id, value AS x, lead(value) OVER (PARTITION BY doc_id ORDER BY t) - value AS y FROM s),
    v AS (SELECT * FROM p WHERE y IS NOT NULL),
    e AS (SELECT doc_id, [{', '.join(f'quantile_cont(x, {i / mo.FRIEDRICH_BINS!r})' for i in range(1, mo.FRIEDRICH_BINS))}]
      AS edges FROM v GROUP BY doc_id),
    b AS (SELECT v.doc_id, x, y, len(list_filter(edges, lambda k: k < x)) AS bin FROM v JOIN e USING (doc_id))
    SELECT doc_id, CAST(bin AS INTEGER) AS bin, {sql_r6('avg(x)')} AS x, {sql_r6('avg(y)')} AS y FROM b GROUP BY doc_id, bin""",
)
def feature_drift_bins(spark, folder):
    bins = mo.drift_bins(lengths(spark, folder), KEYS)
    return bins.select("doc_id", "bin", r6("x").alias("x"), r6("y").alias("y"))


@register("feature_drift")
def feature_drift(spark, folder):
    return long_form(mo.drift_features(lengths(spark, folder)))


def _entropy_sql() -> str:
    radii = [*en.TOLERANCES, en.SAMPLE_TOLERANCE]
    parts = []
    for size in (2, 3):
        cells = ["value"] + [f"x{k}" for k in range(1, size)]
        gap = f"greatest({', '.join(f'abs(a.{c} - b.{c})' for c in cells)})"
        parts.append(
            f"""w{size} AS (SELECT doc_id, {', '.join(cells)}, count(*) AS c FROM l WHERE {cells[-1]} IS NOT NULL GROUP BY ALL),
            n{size} AS (SELECT a.doc_id, any_value(a.c) AS c, {', '.join(f'sum(b.c) FILTER (g <= {r} * sd) AS k{i}' for i, r in enumerate(radii))}
              FROM (SELECT a.*, b.c AS bc, {gap} AS g FROM w{size} a JOIN w{size} b USING (doc_id)) a
              JOIN sds USING (doc_id) GROUP BY a.doc_id, {', '.join('a.' + c for c in cells)}),
            f{size} AS (SELECT doc_id, {', '.join(f'sum(c * ln(k{i} / m)) / any_value(m) AS phi{i}' for i in range(5))},
              sum(c * (k5 - 1)) AS pairs FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS m FROM n{size}) GROUP BY doc_id)""".replace(
                "sum(b.c)", "sum(bc)"
            )
        )
    names = [
        (f"approximate_entropy__m_2__r_{num(r)}", f"CASE WHEN n <= 3 THEN 0 ELSE abs(f2.phi{i} - f3.phi{i}) END")
        for i, r in enumerate(en.TOLERANCES)
    ]
    names.append(("sample_entropy", "CASE WHEN n > 3 AND f2.pairs > 0 AND f3.pairs > 0 THEN -ln(f3.pairs / f2.pairs) END"))
    return unpivot(
        f"""{BASE}, {STATS},
        l AS (SELECT doc_id, value, {_leads('value', 'x', 2)} FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY t)),
        {', '.join(parts)},""",
        names,
        "FROM st LEFT JOIN f2 USING (doc_id) LEFT JOIN f3 USING (doc_id)",
    )


@register("feature_entropies", _entropy_sql())
def feature_entropies(spark, folder):
    return long_form(en.entropy_features(lengths(spark, folder)))


@register(
    "feature_imputation",
    f"""{BASE}, {STATS}, f AS (SELECT doc_id, 'spread' AS feature, CASE WHEN sd > 2.5 THEN 'Infinity'::DOUBLE
        WHEN sd < 1.5 THEN '-Infinity'::DOUBLE WHEN n < 10 THEN NULL ELSE round(sd, 3) END AS value
      FROM st JOIN sds USING (doc_id)),
    g AS (SELECT max(value) AS top, min(value) AS low, median(value) AS middle FROM f
      WHERE isfinite(value))
    SELECT doc_id, feature, {sql_r6("CASE WHEN value = 'Infinity' THEN top WHEN value = '-Infinity' THEN low WHEN value IS NULL THEN middle ELSE value END")}
      AS value FROM f, g""",
)
def feature_imputation(spark, folder):
    series = lengths(spark, folder)
    sds = series.groupBy("doc_id").agg(F.stddev_pop("value").alias("sd"), F.count(F.lit(1)).alias("n"))
    value = (
        F.when(F.col("sd") > 2.5, F.lit(float("inf")))
        .when(F.col("sd") < 1.5, F.lit(float("-inf")))
        .when(F.col("n") < 10, F.lit(None))
        .otherwise(F.round("sd", 3))
    )
    filled = ex.impute(sds.select("doc_id", F.lit("spread").alias("feature"), value.alias("value")))
    return filled.select("doc_id", "feature", r6("value").alias("value"))


@register("feature_catalogue")
def feature_catalogue(spark, folder):
    """Every calculator over the length distribution of every document."""
    raw = stored(ex.extract_features(checkpointed(shares(spark, folder))), "features")
    return rounded(ex.impute(raw).select("doc_id", "feature", "value"), "value")


@register(
    "feature_groups_wide_union",
    f"""{BASE}, s2 AS (SELECT doc_id, 'tokenlenseq' AS grp, value FROM s), {SQL_LENGTH_SHARES.replace(chr(10) + 's AS (', chr(10) + 's3 AS (')},
    u AS (SELECT * FROM s2 UNION ALL SELECT doc_id, 'tokenlendist', value FROM s3)
    SELECT grp, count(DISTINCT doc_id) AS n_docs, {sql_r6('sum(value)')} AS total, {sql_r6('sum(value * value)')} AS energy
    FROM u GROUP BY grp""",
)
def feature_groups_wide_union(spark, folder):
    """Two feature groups in one long table, summed per group."""
    both = lengths(spark, folder).unionByName(shares(spark, folder))
    values = ex.extract_features(both, families=["aggregate"])
    kept = values.filter(F.col("feature").rlike("__(sum_values|abs_energy)$"))
    name = F.element_at(F.split("feature", "__"), 2)
    return kept.groupBy("grp").agg(
        F.countDistinct("doc_id").alias("n_docs"),
        r6(F.sum(F.when(name == "sum_values", F.col("value")))).alias("total"),
        r6(F.sum(F.when(name == "abs_energy", F.col("value")))).alias("energy"),
    )


@register("conversation_features")
def conversation_features(spark, folder):
    """The same calculators on another text table: one series per conversation turn."""
    turns = table(spark, folder, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text"
    )
    series = mp.TokenLengthSequence(tokenizer=tx.treebank).transform(turns)
    values = ex.extract_features(series, families=ex.BASIC_FAMILIES)
    return values.select("doc_id", "feature", r6("value").alias("value"))
