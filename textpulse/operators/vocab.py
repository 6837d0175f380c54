"""Corpus vocabularies: counts, first positions, ranks, document frequency, TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpulse.operators.grams import gram_table, gram_weights
from textpulse.operators.lookup import looked_up
from textpulse.operators.positions import with_position
from textpulse.operators.tokens import count_by, stem_of
from textpulse.session import checkpointed


def vocabulary(token_rows: DataFrame, stem_mode: str = "identity", by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``..., token, freq, first_doc, first_pos): corpus count and first occurrence.

    Counts raw tokens first, so the shuffle carries one row per token and map
    task, and stems the distinct tokens only.
    """
    raw = token_rows.groupBy(*by, "token").agg(
        F.count(F.lit(1)).alias("freq"), F.min(F.struct("doc_id", "pos")).alias("_first")
    )
    if stem_mode != "identity":
        if by:
            stems = stem_of(raw.select("token").distinct(), stem_mode)
            raw = raw.join(stems, "token")
        else:
            raw = stem_of(raw, stem_mode)
        raw = raw.groupBy(*by, F.col("stem").alias("token")).agg(
            F.sum("freq").alias("freq"), F.min("_first").alias("_first")
        )
    return raw.select(
        *by, "token", "freq", F.col("_first.doc_id").alias("first_doc"), F.col("_first.pos").alias("first_pos")
    )


def training_vocabularies(per_fold: DataFrame, k: int) -> DataFrame:
    """(fold, token, freq, first_doc, first_pos) of every fold's training side, from counts per fold.

    ``per_fold`` is :func:`vocabulary` by fold. A training count is the total
    minus the fold's own count, a first position the least over the other
    folds: the texts are counted once for all folds.
    """
    entry = F.struct("fold", "freq", F.struct("first_doc", "first_pos").alias("first"))
    tokens = per_fold.groupBy("token").agg(F.collect_list(entry).alias("es"))
    rows = tokens.select("token", "es", F.explode(F.array(*[F.lit(f) for f in range(k)])).alias("fold"))
    others = rows.select("fold", "token", F.filter("es", lambda e: e["fold"] != F.col("fold")).alias("es"))
    return others.filter(F.size("es") > 0).select(
        "fold", "token",
        F.aggregate("es", F.lit(0).cast("bigint"), lambda a, e: a + e["freq"]).alias("freq"),
        F.array_min(F.transform("es", lambda e: e["first"])).alias("_first"),
    ).select(
        "fold", "token", "freq", F.col("_first.first_doc").alias("first_doc"), F.col("_first.first_pos").alias("first_pos")
    )


def ranked(vocab: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add ``rank``: 1 for the most frequent token, ties in first-seen order."""
    order = [F.col("freq").desc(), F.col("first_doc"), F.col("first_pos")]
    if not by:
        return with_position(vocab, order, "rank")
    placed = with_position(vocab, [*by, *order], "rank")
    before = placed.groupBy(*by).agg((F.min("rank") - 1).alias("_before"))
    return placed.join(F.broadcast(before), by).withColumn("rank", F.col("rank") - F.col("_before")).drop("_before")


def max_rank(ranks: DataFrame) -> DataFrame:
    """One row: the largest rank."""
    return ranks.agg(F.max("rank").alias("max_rank"))


def top_vocabulary(vocab: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The ``k`` most frequent tokens (ties: smaller token first), ``t`` in token order.

    The global form keeps k rows per task before they meet. With groups, all
    groups' tokens are placed in one range-partitioned order, whatever k is; the
    numbering window sees k rows.
    """
    if by:
        placed = with_position(vocab, [*by, F.col("freq").desc(), "token"], "_k")
        before = placed.groupBy(*by).agg((F.min("_k") - 1).alias("_before"))  # one row a group
        kept = placed.join(F.broadcast(before), by).filter(F.col("_k") - F.col("_before") <= k).drop("_k", "_before")
        return kept.withColumn("t", F.row_number().over(Window.partitionBy(*by).orderBy("token")) - 1)
    top = vocab.orderBy(F.col("freq").desc(), F.col("token")).limit(k)
    return top.withColumn("t", F.row_number().over(Window.orderBy("token")) - 1)


def document_frequency(doc_counts: DataFrame) -> DataFrame:
    """(token, df) from one row per (document, token)."""
    return count_by(doc_counts, "token", name="df")


def tfidf(
    doc_counts: DataFrame,
    n_docs: DataFrame,
    df_table: DataFrame | None = None,
    min_df: float = 0.0,
    sublinear: bool = False,
    sizes: tuple[int, int] = (1, 5),
) -> DataFrame:
    """(doc_id, token, weight): tf * (ln((1+n)/(1+df)) + 1), scaled to length 1 per document.

    ``doc_counts`` is (doc_id, token, n), best counted in the documents' tasks (``tokens.document_counts``), ``n_docs``
    a one-row table (n_docs).
    ``min_df`` is a share of the documents. With ``df_table`` of a training
    set, unseen tokens drop out. In place of counts there may be texts (``grams.texts_by_document``), whose character
    n-grams of ``sizes`` are the tokens: those kept are then held by every task, so ``min_df`` must leave few.
    """
    whole = "texts" in doc_counts.columns
    if df_table is None:
        df_table = gram_table(doc_counts, sizes).select(F.col("gram").alias("token"), "df") if whole else document_frequency(doc_counts)
    counted = df_table.withColumn("n_docs", n_docs.scalar())
    kept = counted.filter(F.col("df") >= F.lit(min_df) * F.col("n_docs"))
    idf = checkpointed(kept.select("token", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"), "df"))
    if whole:
        known = idf.select("token", "idf").orderBy("token").toArrow()
        names = idf.sparkSession.createDataFrame([(known["token"].to_pylist(),)], "tokens array<string>")
        pairs = F.inline(F.arrays_zip("ids", "weights"))
        found = gram_weights(doc_counts, known, sublinear).select("doc_id", pairs)
        return found.select("doc_id", F.get(names.scalar(), F.col("ids")).alias("token"), F.col("weights").alias("weight"))
    tf = (1 + F.log("n")) if sublinear else F.col("n").cast("double")
    raw = looked_up(doc_counts, idf, ["token"], "df").select("doc_id", "token", (tf * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "token", (F.col("w") / norm).alias("weight"))


def class_distribution(docs: DataFrame, label: str = "label") -> DataFrame:
    """Documents per class, largest first."""
    return count_by(docs, label).orderBy(F.col("n").desc(), label)
