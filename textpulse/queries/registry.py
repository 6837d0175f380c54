"""Query registry: a Spark callable per name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.functions import text as tx
from textpulse.functions.stemmer import stem_sql
from textpulse.sources.tables import read_documents, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(x: Column | str) -> Column:
    """Six decimals, without negative zero.

    The tiny shift keeps exact ties (k + 0.5 in the sixth decimal), which short
    fractions often hit, away from the rounding border in both engines.
    """
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(1.7e-10), 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def sql_r6(x: str) -> str:
    return f"(round({x} + 1.7e-10, 6) + 0.0)"


def micros(x: str) -> Column:
    """Millionths as integers: long sums of them do not depend on the order of addition."""
    return F.round(F.col(x) * 1e6).cast("bigint")


def sql_micros(x: str) -> str:
    return f"CAST(round({x} * 1e6) AS BIGINT)"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_documents(spark, folder)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name)


# SQL fragments shared by the oracles (common table expressions).
SQL_TOKENS = f"""tok AS (
  SELECT doc_id, label, unnest(ts) AS token, unnest(range(len(ts))) AS pos
  FROM (SELECT doc_id, lang AS label, regexp_extract_all(text, '{tx.WORD_OR_MARK}', 1) AS ts FROM documents))"""
SQL_WORDS = f"""word AS (
  SELECT doc_id, label, unnest(ts) AS token, unnest(range(len(ts))) AS pos
  FROM (SELECT doc_id, lang AS label, regexp_extract_all(lower(text), '{tx.WORD_OF_TWO}', 1) AS ts FROM documents))"""
SQL_VOCAB = """vocab AS (
  SELECT token, count(*) AS freq, min(struct_pack(d := doc_id, p := pos)) AS f FROM tok GROUP BY token),
ranks AS (
  SELECT token, freq, f.d AS first_doc, f.p AS first_pos,
         row_number() OVER (ORDER BY freq DESC, f.d, f.p) AS rank FROM vocab)"""
SQL_SERIES = """s AS (
  SELECT doc_id, pos AS t, CAST(length(token) AS DOUBLE) AS value FROM tok
  UNION ALL SELECT doc_id, 0, 0.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tok))"""
SQL_LENGTH_SHARES = """sizes AS (SELECT doc_id, count(*) AS m FROM tok GROUP BY doc_id),
s AS (
  SELECT d.doc_id, g.k - 1 AS t, coalesce(c.c / z.m, 0.0) AS value
  FROM documents d CROSS JOIN (SELECT unnest(range(1, 15)) AS k) g
  LEFT JOIN (SELECT doc_id, length(token) AS k, CAST(count(*) AS DOUBLE) AS c FROM tok GROUP BY 1, 2) c
    ON c.doc_id = d.doc_id AND c.k = g.k
  LEFT JOIN sizes z ON z.doc_id = d.doc_id)"""


def treebank_sql(column: str = "text") -> str:
    """The tokenizer's rewriting rules as nested regexp_replace calls."""

    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def step(expr: str, pattern: str, replacement: str) -> str:
        target = replacement.replace("$", "\\")
        return f"regexp_replace({expr}, {quote(pattern)}, {quote(target)}, 'g')"

    out = step(column, r"\s+", " ")
    out = step(out, tx.SENTENCE_END, "$1\n$2")
    out = step(out, "\n", " \n ")
    out = f"(' ' || {out} || ' ')"
    out = step(out, "(?m)^ +", "")
    for pattern, replacement in tx.TREEBANK_RULES:
        out = step(out, pattern, replacement)
    return f"regexp_extract_all({out}, {quote(tx.NON_SPACE)}, 1)"


def sql_stemmed(raw: str, out: str, cased: bool) -> str:
    """Common table expressions: ``out`` is ``raw`` (doc_id, token, pos) with Porter stems, if ``cased`` with the token's capitals."""
    restored = """CASE WHEN stem = token THEN stem ELSE array_to_string(list_transform(range(1, length(stem) + 1), lambda i:
      CASE WHEN substring(stem, i, 1) <> substring(token, i, 1) AND upper(substring(stem, i, 1)) = substring(token, i, 1)
      THEN substring(token, i, 1) ELSE substring(stem, i, 1) END), '') END"""
    return f"""{out}_v AS MATERIALIZED (SELECT token, {stem_sql('token')} AS stem FROM (SELECT DISTINCT token FROM {raw})),
    {out}_s AS MATERIALIZED (SELECT token, {restored if cased else 'stem'} AS stem FROM {out}_v),
    {out} AS (SELECT r.doc_id, r.pos, v.stem AS token FROM {raw} r JOIN {out}_s v USING (token))"""


SQL_TREEBANK = f"""treebank AS (SELECT doc_id, unnest(ts) AS token, unnest(range(len(ts))) AS pos
    FROM (SELECT doc_id, {treebank_sql()} AS ts FROM documents))"""
