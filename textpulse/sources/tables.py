"""Reading text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """Repartition a table that has fewer partitions than the cluster has cores.

    A small file arrives as one or two partitions and would leave cores idle in
    the text functions; a large table is left as it is scanned.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_documents(spark: SparkSession, folder: str, label: str | Column = "lang") -> DataFrame:
    """Documents as (doc_id, text, label)."""
    docs = read_table(spark, folder, "documents")
    column = F.col(label) if isinstance(label, str) else label
    return spread(docs.select("doc_id", "text", column.cast("string").alias("label")))


def read_labelled_csv(spark: SparkSession, path: str, text: str = "text", label: str = "author") -> DataFrame:
    """Labelled texts from CSV: header, UTF-8, quoted fields with doubled quotes, line breaks in quotes.

    The file carries no key, so a row's key is its position among the texts of
    its file split: unique and increasing, not consecutive.
    """
    rows = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .option("encoding", "UTF-8")
        .schema(f"{text} string, {label} string")
        .csv(path)
    )
    return rows.select(
        F.monotonically_increasing_id().alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.col(label).alias("label"),
    )


def write_labelled_csv(docs: DataFrame, path: str, text: str = "text", label: str = "author") -> None:
    """Write (text, label) in the form :func:`read_labelled_csv` reads."""
    docs.select(F.col("text").alias(text), F.col("label").alias(label)).write.mode("overwrite").option(
        "header", True
    ).option("quote", '"').option("escape", '"').option("quoteAll", True).option("encoding", "UTF-8").csv(path)
