"""What the operators share: registration, tables in the shared folder, joins with a checked broadcast."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpulse.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Most rows of a narrow table (ids, digests) that is broadcast; above it the join shuffles both sides.
BROADCAST_ROWS = 1_000_000
#: Rows of an Arrow batch of texts.
TEXT_ROWS = 1000


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> str:
    """Path of ``df`` as a Parquet table in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` by way of a table in the shared folder: its rows are fixed and survive a lost executor."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, hinted for broadcast if it has at most ``limit`` rows. Give it a table that is cheap to count."""
    return F.broadcast(df) if df.count() <= limit else df


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the rows of an Arrow batch to TEXT_ROWS in its session, so that a batch of whole texts stays
    small in the JVM and in Python. A lower setting is left as it is."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= TEXT_ROWS:
        conf.set(name, str(TEXT_ROWS))
    return df


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_tp_file`` and ``_tp_row``, which say where each row is stored.

    A frame that does not come straight from files is written to the shared folder first.
    """
    try:
        docs.select("_metadata.row_index")
    except Exception as e:  # pyspark raises AnalysisException; other errors come again below
        if "row_index" not in str(e) and "_metadata" not in str(e):
            raise
        docs = written(docs, "located")
    return docs.withColumns({"_tp_file": F.col("_metadata.file_path"), "_tp_row": F.col("_metadata.row_index")})


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_tp_uid``, a number of each stored row that stays the same from scan to scan.

    It is made of the number of the row's file, in order of the paths, and the row's place in it.
    """
    rows = located(docs)
    files = rows.select("_tp_file").distinct()
    order = Window.orderBy("_tp_file")  # one row a file
    files = written(files.select("_tp_file", (F.row_number().over(order) - 1).cast("long").alias("_number")), "files")
    uid = F.shiftleft("_number", 40).bitwiseOR(F.col("_tp_row"))
    return rows.join(small(files), "_tp_file").withColumn("_tp_uid", uid).drop("_tp_file", "_tp_row", "_number")


def whole_text(column: str = "text"):
    """The text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
