"""Tables of tokens: validation, tokenising, stemming, stop words, n-grams."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse.functions import text as tx
from textpulse.functions.stemmer import porter_stem
from textpulse.functions.stop_words import ENGLISH
from textpulse.operators.grams import gram_table, texts_by_document
from textpulse.operators.lookup import looked_up
from textpulse.session import checkpointed


#: Characters of text whose terms a task counts, about.
TASK_CHARACTERS = 4_000_000


def check_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Raise unless ``text`` is a string column without nulls and there is a row."""
    if not isinstance(docs.schema[text].dataType, T.StringType):
        raise TypeError(f"{text} must be a string column")
    seen = text_profile(docs, text, key).first()
    if seen.n_docs == 0:
        raise ValueError("no documents given")
    if seen.n_null:
        raise ValueError(f"{seen.n_null} documents have no {text}")
    return docs


def text_profile(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The counts behind :func:`check_texts`, in one scan."""
    return docs.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col(text).isNull()).alias("n_null"),
        F.count_if(F.col(text) == "").alias("n_empty"),
        F.count_if(F.col(key).isNull()).alias("n_without_key"),
    )


def one_task_per_text(docs: DataFrame, keep: list[str], least: int = 1) -> DataFrame:
    """Shuffle whole texts by document, so that all later steps per document stay local.

    Moving a text once is cheaper than moving its exploded tokens, and a
    document is one input row, which bounds the size of its group. The number of
    partitions is the session's, and given, as AQE would merge by the size of
    the texts, of which the series is a multiple. Asking the plan for its own
    number would run its shuffles. There are ``least`` partitions or more.
    """
    spark = docs.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(max(wanted, spark.sparkContext.defaultParallelism, least), keep[0])


def whole_texts(docs: DataFrame, parts: Column, key: str = "doc_id") -> DataFrame:
    """(key, alone, parts): ``parts`` of every text, texts of one key in one task; ``alone`` if the key has one row.

    What a text alone decides is worked out in its row. Only keys with several rows need their texts' parts as rows.
    """
    placed = one_task_per_text(docs.select(key, "text"), [key])
    alone = F.count(F.lit(1)).over(Window.partitionBy(key)) == 1
    return placed.withColumn("alone", alone).select(key, "alone", parts.alias("parts"))


def part_profile(rows: DataFrame, *keys: str) -> DataFrame:
    """(``keys``..., n_tokens, n_distinct, n_chars, checksum, first_token, last_token) of :func:`whole_texts` rows.

    ``keys`` begin with the texts' key. Groups without parts give no row.
    """
    add = lambda a, x: a + x
    total = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), add)
    lengths = lambda w: F.length(w).cast("bigint")
    sized = rows.select(
        *keys,
        F.size("parts").alias("n_tokens"),
        F.when(F.col("alone"), F.size(F.array_distinct("parts"))).alias("n_own"),
        total(F.transform("parts", lengths)).alias("n_chars"),
        total(F.transform("parts", lambda w, i: (i + 1) * lengths(w))).alias("checksum"),
        F.array_min("parts").alias("first_token"),
        F.array_max("parts").alias("last_token"),
        # Where rows share a key, their distinct parts meet as rows, and the first of them carries the text's numbers.
        F.when(~F.col("alone"), F.array_distinct("parts")).alias("shared"),
    )
    numbers = ["n_tokens", "n_own", "n_chars", "checksum", "first_token", "last_token"]
    met = sized.select(*keys, *numbers, F.posexplode_outer("shared").alias("at", "token"))
    first = F.coalesce("at", F.lit(0)) == 0
    once = lambda c: F.when(first, F.col(c))
    return met.groupBy(*keys).agg(
        F.sum(once("n_tokens")).alias("n_tokens"),
        (F.coalesce(F.sum(once("n_own")), F.lit(0)) + F.countDistinct("token")).alias("n_distinct"),
        F.sum(once("n_chars")).alias("n_chars"),
        F.sum(once("checksum")).alias("checksum"),
        F.min("first_token").alias("first_token"),
        F.max("last_token").alias("last_token"),
    ).filter("n_tokens > 0")


def tokens(
    docs: DataFrame, tokenizer: tx.Tokenizer = tx.word_marks, keep: list[str] | None = None, text: str = "text"
) -> DataFrame:
    """One row per token: (``keep``..., pos, token); texts without tokens give no row.

    The outer form with a filter, because for the inner form Catalyst infers a
    size() filter that runs the tokenizer a second time.
    """
    keep = keep or ["doc_id"]
    rows = docs.select(*keep, F.posexplode_outer(tokenizer(F.col(text))).alias("pos", "token"))
    return rows.filter("pos is not null")


def tokens_or_mark(
    docs: DataFrame, tokenizer: tx.Tokenizer, keep: list[str] | None = None, text: str = "text"
) -> DataFrame:
    """Like :func:`tokens`, but a text without tokens gives one row with a null ``pos``.

    Its token is a NUL-prefixed document key: it matches no vocabulary, and
    many empty texts do not meet in one join task as null keys would.
    """
    keep = keep or ["doc_id"]
    rows = docs.select(*keep, F.posexplode_outer(tokenizer(F.col(text))).alias("pos", "token"))
    blank = F.concat(F.lit("\0"), F.col(keep[0]).cast("string"))
    return rows.withColumn("token", F.coalesce("token", blank))


def stem_of(df: DataFrame, mode: str, token: str = "token") -> DataFrame:
    """Add ``stem`` to a table of **distinct** tokens.

    ``identity`` and ``lower`` are plain expressions, ``porter`` stems the lower
    case form, ``porter_case`` also gives back the token's capitals.
    """
    if mode == "identity":
        return df.withColumn("stem", F.col(token))
    if mode == "lower":
        return df.withColumn("stem", F.lower(token))
    # AQE would merge a small vocabulary into few tasks.
    spread = df.repartition(df.sparkSession.sparkContext.defaultParallelism, token)
    stemmed = spread.withColumn("stem", porter_stem(token))
    if mode == "porter":
        return stemmed
    if mode == "porter_case":
        return stemmed.withColumn("stem", tx.restore_case(F.col("stem"), F.col(token)))
    raise ValueError(f"unknown stem mode {mode}")


def stemmed(token_rows: DataFrame, mode: str = "porter_case") -> DataFrame:
    """Replace every token by its stem; the stemmer sees each distinct token once."""
    if mode in ("identity", "lower"):
        return stem_of(token_rows, mode).drop("token").withColumnRenamed("stem", "token")
    stems = counted_stems(token_rows, mode)
    return looked_up(token_rows, stems, ["token"], "_freq").drop("token").withColumnRenamed("stem", "token")


def counted_stems(token_rows: DataFrame, mode: str) -> DataFrame:
    """(token, _freq, stem) of the distinct tokens, stored: a join on the stem would have it worked out again to test for nulls."""
    return checkpointed(stem_of(count_by(token_rows.filter("token is not null"), "token", name="_freq"), mode))


def english_stop_words(spark: SparkSession) -> DataFrame:
    """The English stop-word list as a one-column table."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in ENGLISH])).alias("token"))


def without_stop_words(token_rows: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Drop stop words; the list is a fixed small table, so it is broadcast."""
    return token_rows.join(F.broadcast(stop_words), "token", "left_anti")


def _sized_ngrams(split: DataFrame, keep: list[str], grams_of, sizes: tuple[int, int], parts: str) -> DataFrame:
    """(keep..., n, grams): the array of the n-grams of every size."""
    per_size = F.array(*[
        F.struct(F.lit(n).alias("n"), grams_of(F.col(parts), n).alias("grams")) for n in range(sizes[0], sizes[1] + 1)
    ])
    return split.select(*keep, F.inline_outer(per_size))


def _ngram_rows(docs: DataFrame, keep: list[str], parts: Column, grams_of, sizes: tuple[int, int]) -> DataFrame:
    sized = _sized_ngrams(docs.select(*keep, parts.alias("_parts")), keep, grams_of, sizes, "_parts")
    return sized.select(*keep, "n", F.explode_outer("grams").alias("gram")).filter("gram is not null")


def char_ngrams(docs: DataFrame, sizes: tuple[int, int] = (1, 5), keep: list[str] | None = None) -> DataFrame:
    """Character n-grams of the lower-cased, space-collapsed text."""
    chars = tx.characters(tx.folded_text(F.col("text")))
    return _ngram_rows(docs, keep or ["doc_id"], chars, tx.char_ngrams, sizes)


def folded_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, texts) whose n-grams are those of :func:`char_ngrams`."""
    return texts_by_document(docs, tx.folded_text(F.col("text")))


def char_ngram_table(docs: DataFrame, sizes: tuple[int, int] = (1, 5)) -> DataFrame:
    """(n, gram, freq, df) of :func:`char_ngrams`: how often an n-gram occurs and in how many documents."""
    return gram_table(folded_texts(docs), sizes)


def raw_char_ngram_table(docs: DataFrame, sizes: tuple[int, int] = (1, 3)) -> DataFrame:
    """(n, gram, freq, df) of :func:`raw_char_ngrams`."""
    return gram_table(texts_by_document(docs), sizes)


def raw_char_ngrams(docs: DataFrame, sizes: tuple[int, int] = (1, 3), keep: list[str] | None = None) -> DataFrame:
    """Character n-grams of the text as written."""
    return _ngram_rows(docs, keep or ["doc_id"], tx.characters(F.col("text")), tx.char_ngrams, sizes)


def word_ngrams(docs: DataFrame, sizes: tuple[int, int] = (1, 3), keep: list[str] | None = None) -> DataFrame:
    """Word n-grams over the default word analyser."""
    return _ngram_rows(docs, keep or ["doc_id"], tx.words(F.col("text")), tx.word_ngrams, sizes)


def word_ngram_profile(docs: DataFrame, sizes: tuple[int, int] = (1, 3)) -> DataFrame:
    """:func:`part_profile` of the grams of :func:`word_ngrams` by document and size."""
    split = whole_texts(docs, tx.words(F.col("text")))
    sized = _sized_ngrams(split, ["doc_id", "alone"], tx.word_ngrams, sizes, "parts")
    return part_profile(sized.withColumnRenamed("grams", "parts"), "doc_id", "n")


def document_counts(docs: DataFrame, terms: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, token, n) of the (doc_id, token) rows that ``terms`` makes of documents, counted in the document's task.

    The number of tasks grows with the texts, so that a task's counts, and a sort of them, fit its memory.
    """
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return count_by(terms(one_task_per_text(docs, ["doc_id"], math.ceil(size / TASK_CHARACTERS))), "doc_id", "token")


def count_by(token_rows: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    return token_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
