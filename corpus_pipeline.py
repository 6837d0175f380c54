"""Cleaning and encoding of a document corpus in stages; each works on all that its predecessor kept.

A stage gets the documents as a stored table and returns the rows that stay, with the columns of documents; the last
one returns their token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.common import read, whole_text, written
from textpulse.llm.decontamination import decontaminated
from textpulse.llm.exact_dedup import without_copies
from textpulse.llm.language_id import accepted
from textpulse.llm.near_dedup import one_per_group
from textpulse.llm.piece_bpe import with_ids_and_text

TOKENIZER = "piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is recognised; those without letters, or far from every profile, go."""
    return accepted(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every group of equal texts."""
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every group linked at 80 in 100 of five-word shingles."""
    return one_per_group(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no item of the benchmark table, re-parameterised ones included."""
    return decontaminated(docs, read(spark, folder, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document, their number, and whether they decode to the text."""
    path = public_tokenizers.path(TOKENIZER)
    coded = with_ids_and_text(docs.select("doc_id", "lang", "source", "n_chars", "text"), path)
    return coded.select(
        "doc_id", "lang", "source", "n_chars", "ids", F.size("ids").alias("n_tokens"), (F.col("decoded") == whole_text()).alias("exact")
    )


STAGES = [
    ("language", language),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: No SQL: model training, approximate search and tokenisation cannot be said in it.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
