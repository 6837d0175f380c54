"""The five series mappers."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpulse.functions import text as tx
from textpulse.operators import mappers as mp
from textpulse.queries.registry import (
    SQL_LENGTH_SHARES,
    SQL_SERIES,
    SQL_TOKENS,
    SQL_TREEBANK,
    SQL_VOCAB,
    SQL_WORDS,
    documents,
    micros,
    r6,
    register,
    sql_micros,
    sql_r6,
    sql_stemmed,
    table,
)
from textpulse.sources.tables import spread


def _digest(series):
    """Per-document digest that depends on every value and its place."""
    return series.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(micros("value")).alias("total"), r6(F.max("value")).alias("largest"),
        F.sum(micros("value") * (F.col("t") % 97 + 1)).alias("checksum"),
    )


_DIGEST_SQL = f"""SELECT doc_id, count(*) AS n, CAST(sum({sql_micros('value')}) AS BIGINT) AS total, {sql_r6('max(value)')} AS largest,
  CAST(sum({sql_micros('value')} * (t % 97 + 1)) AS BIGINT) AS checksum FROM s GROUP BY doc_id"""


@register("token_length_sequence", f"WITH {SQL_TOKENS}, {SQL_SERIES} {_DIGEST_SQL}")
def token_length_sequence(spark, folder):
    return _digest(mp.TokenLengthSequence(tokenizer=tx.word_marks).transform(documents(spark, folder)))


@register(
    "token_frequency_sequence",
    f"""WITH {SQL_TOKENS}, {SQL_VOCAB}, s AS (
    SELECT doc_id, pos AS t, ln(1 + freq) AS value FROM tok JOIN vocab USING (token)
    UNION ALL SELECT doc_id, 0, 0.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tok)) {_DIGEST_SQL}""",
)
def token_frequency_sequence(spark, folder):
    docs = documents(spark, folder)
    return _digest(mp.TokenFrequencySequence(tokenizer=tx.word_marks, stem_mode="identity").fit_transform(docs))


@register(
    "token_rank_sequence",
    f"""WITH {SQL_TOKENS}, {SQL_VOCAB}, s AS (
    SELECT doc_id, pos AS t, ln(1 + rank) AS value FROM tok JOIN ranks USING (token)
    UNION ALL SELECT doc_id, 0, 0.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tok)) {_DIGEST_SQL}""",
)
def token_rank_sequence(spark, folder):
    docs = documents(spark, folder)
    return _digest(mp.TokenRankSequence(tokenizer=tx.word_marks, stem_mode="identity").fit_transform(docs))


@register(
    "token_rank_sequence_unseen",
    f"""WITH {SQL_TOKENS}, {SQL_VOCAB}, b AS (
      SELECT item_id AS doc_id, unnest(ts) AS token, unnest(range(len(ts))) AS t
      FROM (SELECT item_id, regexp_extract_all(text, '{tx.WORD_OR_MARK}', 1) AS ts FROM benchmark)),
    s AS (SELECT doc_id, t, ln(1 + coalesce(rank, (SELECT max(rank) + 1 FROM ranks))) AS value
      FROM b LEFT JOIN ranks USING (token)) {_DIGEST_SQL}""",
)
def token_rank_sequence_unseen(spark, folder):
    """Ranks learnt on the documents, applied to the benchmark passages."""
    items = spread(table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    fitted = mp.TokenRankSequence(tokenizer=tx.word_marks, stem_mode="identity").fit(documents(spark, folder))
    return _digest(fitted.transform(items))


@register(
    "token_length_distribution",
    f"WITH {SQL_TOKENS}, {SQL_LENGTH_SHARES} SELECT doc_id, CAST(t AS INTEGER) AS t, {sql_r6('value')} AS value FROM s",
)
def token_length_distribution(spark, folder):
    series = mp.TokenLengthDistribution(tokenizer=tx.word_marks).transform(documents(spark, folder))
    return series.select("doc_id", "t", r6("value").alias("value"))


@register(
    "token_rank_distribution",
    f"""WITH {SQL_WORDS}, top AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS t FROM (
      SELECT token, count(*) AS freq FROM word GROUP BY token ORDER BY freq DESC, token LIMIT 1000)),
    c AS (SELECT doc_id, t, count(*) AS n FROM word JOIN top USING (token) GROUP BY 1, 2),
    s AS (SELECT d.doc_id, top.t, coalesce(n, 0) AS value FROM documents d CROSS JOIN top
      LEFT JOIN c ON c.doc_id = d.doc_id AND c.t = top.t) {_DIGEST_SQL}""",
)
def token_rank_distribution(spark, folder):
    docs = documents(spark, folder)
    return _digest(mp.TokenRankDistribution(stem_mode="identity").fit_transform(docs))


@register(
    "stemmed_frequency_sequence",
    f"""WITH {SQL_TREEBANK}, {sql_stemmed('treebank', 'tok', True)}, vocab AS (SELECT token, count(*) AS freq FROM tok GROUP BY token), s AS (
    SELECT doc_id, pos AS t, ln(1 + freq) AS value FROM tok JOIN vocab USING (token)
    UNION ALL SELECT doc_id, 0, 0.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tok)) {_DIGEST_SQL}""",
)
def stemmed_frequency_sequence(spark, folder):
    docs = documents(spark, folder)
    return _digest(mp.TokenFrequencySequence().fit_transform(docs))


@register(
    "stemmed_rank_sequence",
    f"""WITH {SQL_TREEBANK}, {sql_stemmed('treebank', 'tok', True)}, {SQL_VOCAB}, s AS (
    SELECT doc_id, pos AS t, ln(1 + rank) AS value FROM tok JOIN ranks USING (token)
    UNION ALL SELECT doc_id, 0, 0.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tok)) {_DIGEST_SQL}""",
)
def stemmed_rank_sequence(spark, folder):
    docs = documents(spark, folder)
    return _digest(mp.TokenRankSequence().fit_transform(docs))


@register(
    "stemmed_rank_distribution",
    f"""WITH {SQL_WORDS.replace('word AS (', 'plain AS (', 1)}, {sql_stemmed('plain', 'word', False)},
    top AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS t FROM (
      SELECT token, count(*) AS freq FROM word GROUP BY token ORDER BY freq DESC, token LIMIT 1000)),
    c AS (SELECT doc_id, t, count(*) AS n FROM word JOIN top USING (token) GROUP BY 1, 2),
    s AS (SELECT d.doc_id, top.t, coalesce(n, 0) AS value FROM documents d CROSS JOIN top
      LEFT JOIN c ON c.doc_id = d.doc_id AND c.t = top.t) {_DIGEST_SQL}""",
)
def stemmed_rank_distribution(spark, folder):
    docs = documents(spark, folder)
    return _digest(mp.TokenRankDistribution().fit_transform(docs))
