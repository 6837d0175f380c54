"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted per host, registered domain and suffix. Each level is shrunk
towards the level above it through a beta-binomial prior: the prior mean of a host is the posterior mean of its
registered domain, whose prior mean is that of its suffix, whose prior mean is the overall rate; the prior
strength of a level is estimated by moments from how much its units differ around their parents. A URL passes
when the lower bound of its host's posterior good rate is high enough. Hosts without labels have the posterior
of their domain, and so on upwards. Explicit rules come before reputation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.common import read, register, written

#: Fixed values: (rule, verdict). A rule is host and path prefix; the longest that fits wins.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Suffixes of two labels under which names are registered; any other suffix is the last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz")
LEVELS = ("host", "domain", "suffix")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*long_suffixes), last_two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    labels = F.when(F.substring_index(host, ".", -2).isin(*long_suffixes), F.substring_index(host, ".", -3))
    return labels.otherwise(F.substring_index(host, ".", -2))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, or null. Rules are a handful of literals."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _levels(counts: DataFrame, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> dict[str, DataFrame]:
    """Label counts ``n, good`` of every host, domain and suffix that has labels, each with its parent."""
    domain_, suffix_ = domain_of(F.col("host"), long_suffixes), suffix_of(F.col("host"), long_suffixes)
    host = counts.select("host", domain_.alias("domain"), suffix_.alias("suffix"), "n", "good")
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    domain = total(host, "domain", "suffix")
    return {"suffix": total(domain, "suffix"), "domain": domain, "host": host}


def _shrunk(units: DataFrame, strongest: float) -> DataFrame:
    """Posterior ``a, b`` of units with ``n, good`` and their parent's mean ``m``, under one beta prior a level.

    With rates p_i around m_i, E[sum n_i (p_i - m_i)^2] = sum v_i (1 + (n_i - 1) rho), v_i = m_i (1 - m_i), and the
    prior strength is 1 / rho - 1, held between 1 and ``strongest``.
    """
    rate = F.col("good") / F.col("n")
    v = F.col("m") * (1 - F.col("m"))
    sums = units.agg(
        F.sum(F.col("n") * (rate - F.col("m")) * (rate - F.col("m"))).alias("spread"),
        F.sum(v).alias("v"),
        F.sum(v * (F.col("n") - 1)).alias("w"),
    )
    rho = F.when(F.col("w") > 0, (F.col("spread") - F.col("v")) / F.col("w")).otherwise(F.lit(1.0))
    rho = F.least(F.greatest(rho, F.lit(1.0 / (1.0 + strongest))), F.lit(0.5))
    strength = sums.select((1 / rho - 1).alias("s"))
    return units.join(F.broadcast(strength)).select(  # one row
        "*", (F.col("m") * F.col("s") + F.col("good")).alias("a"), ((1 - F.col("m")) * F.col("s") + F.col("n") - F.col("good")).alias("b")
    )


def _mean() -> Column:
    return F.col("a") / (F.col("a") + F.col("b"))


def _bound(z: float) -> Column:
    a, b = F.col("a"), F.col("b")
    return _mean() - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))


def reputation(
    counts: DataFrame, z: float = 1.645, strongest: float = 1000.0, long_suffixes: Sequence[str] = LONG_SUFFIXES
) -> dict[str, DataFrame]:
    """Posterior tables by level, ``<level>, bound``, and under ``all`` the one row of the overall rate.

    ``counts``: host, n labels, good ones of them. The overall rate has a uniform prior, so that it is defined
    without labels too.
    """
    levels = _levels(counts, long_suffixes)
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    every = sums.select((F.col("good") + 1.0).alias("a"), (F.col("n") - F.col("good") + 1.0).alias("b"))
    suffix = _shrunk(levels["suffix"].join(F.broadcast(every.select(_mean().alias("m")))), strongest)  # one row
    domain = _shrunk(levels["domain"].join(suffix.select("suffix", _mean().alias("m")), "suffix"), strongest)
    host = _shrunk(levels["host"].drop("suffix").join(domain.select("domain", _mean().alias("m")), "domain"), strongest)
    out = {"suffix": suffix, "domain": domain, "host": host}
    return {"all": every.select(_bound(z).alias("bound"))} | {k: t.select(k, _bound(z).alias("bound")) for k, t in out.items()}


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    least: float = 0.8,
    z: float = 1.645,
    long_suffixes: Sequence[str] = LONG_SUFFIXES,
) -> DataFrame:
    """Add ``host, path, rule, bound, verdict`` to every row of ``pages``.

    ``outcomes``: ``host`` and ``good`` (0, 1 or null, which counts for nothing) of labelled pages. ``least``: the
    posterior bound (mean minus ``z`` standard deviations) from which a URL is allowed. A null URL, or one without
    ``://``, has the empty host, whose reputation is that of all pages unless it has labels itself. Repeated rows are
    judged alike, columns of these names are replaced, an empty table stays empty. ``long_suffixes``: suffixes of two
    labels; the default holds seven, give the public list for real hosts.
    """
    counts = outcomes.filter("good is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
    known = reputation(written(counts, "url-outcomes"), z, long_suffixes=long_suffixes)
    pages = pages.drop("host", "path", "rule", "bound", "verdict")
    split = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})

    # One bound per distinct host; pages then meet it in one join on the host.
    hosts = split.select("host").distinct()
    hosts = hosts.withColumns({"domain": domain_of(F.col("host"), long_suffixes), "suffix": suffix_of(F.col("host"), long_suffixes)})
    for level in LEVELS:
        hosts = hosts.join(known[level].withColumnRenamed("bound", f"b_{level}"), level, "left")
    hosts = hosts.join(F.broadcast(known["all"].withColumnRenamed("bound", "b_all")))  # one row
    bounds = hosts.select("host", F.coalesce("b_host", "b_domain", "b_suffix", "b_all").alias("bound"))

    judged = split.join(bounds, "host").withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bound") >= least, F.lit("allow")).otherwise(F.lit("block"))
    return judged.withColumns({"rule": F.col("_rule.rule"), "verdict": F.coalesce(F.col("_rule.verdict"), own)}).drop("_rule")


_LONG = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)
_SQL_PARTS = f"""
  CASE WHEN list_aggregate(string_split(host, '.')[-2:], 'string_agg', '.') IN ({_LONG})
       THEN list_aggregate(string_split(host, '.')[-3:], 'string_agg', '.')
       ELSE list_aggregate(string_split(host, '.')[-2:], 'string_agg', '.') END AS domain,
  CASE WHEN list_aggregate(string_split(host, '.')[-2:], 'string_agg', '.') IN ({_LONG})
       THEN list_aggregate(string_split(host, '.')[-2:], 'string_agg', '.')
       ELSE string_split(host, '.')[-1] END AS suffix"""


def _sql_level(name: str, units: str) -> str:
    """Common table expression: posterior of the units of a level, which have n, good and m."""
    return f"""{name} AS (
  WITH u AS ({units}),
  s AS (SELECT 1 / least(greatest(CASE WHEN sum(m * (1 - m) * (n - 1)) > 0
      THEN (sum(n * (good / n - m) * (good / n - m)) - sum(m * (1 - m))) / sum(m * (1 - m) * (n - 1)) ELSE 1.0 END,
      1.0 / 1001.0), 0.5) - 1 AS s FROM u)
  SELECT u.*, m * s + good AS a, (1 - m) * s + n - good AS b FROM u, s)"""


def _sql_bound(t: str) -> str:
    return f"({t}.a / ({t}.a + {t}.b) - 1.645 * sqrt({t}.a * {t}.b / (({t}.a + {t}.b) * ({t}.a + {t}.b) * ({t}.a + {t}.b + 1))))"


_SQL = f"""
WITH p AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
c AS (
  SELECT host, count(*) AS n, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good
  FROM p JOIN labels l ON l.doc_id = p.page_id WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY host),
h AS (SELECT *, {_SQL_PARTS} FROM c),
g AS (SELECT coalesce(sum(good), 0) + 1.0 AS a, coalesce(sum(n) - sum(good), 0) + 1.0 AS b FROM c),
{_sql_level("ps", "SELECT suffix, sum(n) AS n, sum(good) AS good, max(a / (a + b)) AS m FROM h, g GROUP BY suffix")},
{_sql_level("pd", "SELECT domain, sum(h.n) AS n, sum(h.good) AS good, max(a / (a + b)) AS m FROM h JOIN ps USING (suffix) GROUP BY domain")},
{_sql_level("ph", "SELECT host, h.n, h.good, a / (a + b) AS m FROM h JOIN pd USING (domain)")},
j AS (
  SELECT p.page_id, p.host, p.path,
    coalesce({_sql_bound("ph")}, {_sql_bound("pd")}, {_sql_bound("ps")}, {_sql_bound("g")}) AS bound,
    CASE WHEN starts_with(path, '/en/') AND (p.host = 'www.example.com' OR ends_with(p.host, '.www.example.com'))
           THEN 'www.example.com/en/'
         WHEN starts_with(path, '/en/') AND (p.host = 'example.com' OR ends_with(p.host, '.example.com')) THEN 'example.com/en/'
         WHEN starts_with(path, '/es/') AND (p.host = 'net' OR ends_with(p.host, '.net')) THEN 'net/es/'
         WHEN starts_with(path, '/fr/') AND (p.host = 'net' OR ends_with(p.host, '.net')) THEN 'net/fr/'
         WHEN starts_with(path, '/') AND (p.host = 'com' OR ends_with(p.host, '.com')) THEN 'com/' END AS rule
  FROM (SELECT *, {_SQL_PARTS} FROM p) p
  LEFT JOIN ph ON ph.host = p.host LEFT JOIN pd ON pd.domain = p.domain LEFT JOIN ps ON ps.suffix = p.suffix, g)
SELECT page_id, host, path, rule, round(bound, 6) AS bound,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN bound >= 0.8 THEN 'allow' ELSE 'block' END AS verdict
FROM j"""


@register("op1_host_reputation", _SQL)
def op1_host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's verdict. A page is labelled by the labels row of its id; good means of quality and not toxic."""
    pages = read(spark, folder, "pages").select("page_id", "url")
    labels = read(spark, folder, "labels").filter("quality is not null and toxic is not null")
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("long")
    outcomes = (
        pages.join(labels.select(F.col("doc_id").alias("page_id"), good.alias("good")), "page_id")
        .select(host_of(F.col("url")).alias("host"), "good")
    )
    judged = judge_urls(pages, outcomes)
    return judged.select("page_id", "host", "path", "rule", F.round("bound", 6).alias("bound"), "verdict")
