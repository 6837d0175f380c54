"""The headline query: how token lengths differ between languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpulse.functions import text as tx
from textpulse.operators import mappers as mp
from textpulse.queries.registry import SQL_SERIES, SQL_TOKENS, documents, r6, register, sql_r6


@register(
    "length_profile_by_language",
    f"""WITH {SQL_TOKENS}, {SQL_SERIES},
    f AS (SELECT doc_id, count(*) AS n, avg(value) AS mean, var_pop(value) AS variance, sum(value * value) AS energy
      FROM s GROUP BY doc_id)
    SELECT lang AS label, count(*) AS n_docs, {sql_r6('avg(n)')} AS length, {sql_r6('avg(mean)')} AS mean,
      {sql_r6('avg(variance)')} AS variance, {sql_r6('avg(energy)')} AS abs_energy
    FROM f JOIN documents USING (doc_id) GROUP BY lang""",
)
def length_profile_by_language(spark, folder):
    series = mp.TokenLengthSequence(tokenizer=tx.word_marks).transform(documents(spark, folder), ["doc_id", "label"])
    v = F.col("value")
    per_doc = series.groupBy("doc_id", "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.sum(v * v).alias("energy")
    )
    return per_doc.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_docs"), r6(F.avg("n")).alias("length"), r6(F.avg("mean")).alias("mean"),
        r6(F.avg("variance")).alias("variance"), r6(F.avg("energy")).alias("abs_energy"),
    )
