"""Language identification by rank-order profiles.

Character n-grams of one to three letters are counted inside words, whose edges count as a space. A language's
profile is the ranking of its most frequent n-grams over all its training texts. A document's own ranking is
compared with every profile: an n-gram adds by how many places it is out, or the profile's length if the profile
lacks it. The language of the least sum is predicted.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from textpulse.llm.common import read, register, small_batches
from textpulse.llm.words import runs

UNKNOWN = "und"
#: N-grams of a profile and of a document's ranking.
PROFILE = 300
_BITS = 21  # of a code point in a packed n-gram


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@functools.lru_cache(maxsize=1)
def _numbering() -> np.ndarray:
    return np.zeros(0x110000, dtype=np.int64)  # room for the numbers of a text's characters


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text: letters, and one space before, between and after words. Empty: no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    points = np.where(_letters()[points], points, 32)
    points = np.concatenate(([32], points, [32]))
    blank = points == 32
    points = points[~(blank & np.concatenate(([False], blank[:-1])))]
    return points if len(points) > 1 else points[:0]


def ngram_counts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams in ascending order, and their counts. N-grams do not go on past a space."""
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    alphabet = np.flatnonzero(np.bincount(points))
    number, size = _numbering(), len(alphabet)
    number[alphabet] = np.arange(size)
    ids = number[points]  # the space is number 0, as letters come after it
    pairs = ids[:-1] * size + ids[1:]
    triples = (pairs[:-1] * size + ids[2:])[ids[1:-1] != 0]
    keys, counts = [], []
    for n, grams in ((1, ids[ids != 0]), (2, pairs), (3, triples)):
        if size**n <= max(1 << 16, 8 * len(grams)):
            every = np.bincount(grams, minlength=1)
            found = np.flatnonzero(every)
            counts.append(every[found])
        else:
            found, some = np.unique(grams, return_counts=True)
            counts.append(some)
        key, rest = np.zeros(len(found), np.int64), found
        for place in range(n):
            rest, last = np.divmod(rest, size)
            key |= alphabet[last] << (_BITS * place)
        keys.append(key)
    return np.concatenate(keys), np.concatenate(counts)


def ranking(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The ``most`` most frequent n-grams, ties by the lower n-gram."""
    return keys[np.argsort(-counts, kind="stable")[:most]]


@dataclass
class Profiles:
    """Rank of every n-gram in every language, -1 where the profile lacks it. Languages are in ascending order."""

    languages: list[str]
    keys: np.ndarray
    ranks: np.ndarray
    most: int

    def predict(self, text: str) -> tuple[str, float]:
        """Language and score, 1 minus the distance as a share of the greatest possible one."""
        top = ranking(*ngram_counts(letters_of(text)), self.most)
        if not len(top) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, top)
        at[at == len(self.keys)] = 0
        theirs = np.where((self.keys[at] == top)[:, None], self.ranks[at], -1)
        out = np.where(theirs < 0, self.most, np.abs(theirs - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(out))
        return self.languages[best], float(1.0 - out[best] / (len(top) * self.most))


def learn(docs: DataFrame, text: str = "text", label: str = "lang", most: int = PROFILE) -> Profiles:
    """Profiles of all languages of ``docs``, from every row whose label is not null.

    Tasks count the n-grams of each language in their texts, Spark adds the counts up. Only the profiles come to the
    driver: ``most`` n-grams a language. Without labelled letters there is no profile.
    """
    schema = "label string, gram bigint, n bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches, "text"):
            labels = batch.column(0).to_pylist()
            for name in sorted(set(labels)):
                mine = " ".join(t for t, x in zip(texts, labels) if x == name)
                keys, counts = ngram_counts(letters_of(mine))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["label", "gram", "n"])

    rows = docs.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    sums = rows.mapInArrow(count, schema).groupBy("label", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("label").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < most).collect()
    languages = sorted({r["label"] for r in top})
    keys = np.array(sorted({r["gram"] for r in top}), dtype=np.int64)
    ranks = np.full((len(keys), len(languages)), -1, dtype=np.int64)
    for r in top:
        ranks[np.searchsorted(keys, r["gram"]), languages.index(r["label"])] = r["rank"]
    return Profiles(languages, keys, ranks, most)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to every row; ``und`` and 0 for a text that is null or has no letter.

    Equal distances go to the language that sorts first. Columns of these names are replaced, others are kept, rows
    are independent of each other.
    """
    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches, text):
            found = [profiles.predict(t) for t in texts]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return small_batches(docs).mapInArrow(judge, schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept out of training: crc32 of its key as text is 1 modulo 3. A null key is the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def accepted(docs: DataFrame, least: float = 0.02) -> DataFrame:
    """The rows whose language is recognised: not ``und``, and a score of at least ``least``.

    Learns from the labelled rows that are not held out; without any there is nothing to judge by, and all rows stay.
    """
    profiles = learn(docs.filter(~held_out()))
    if not profiles.languages:
        return docs
    kept = predict(docs, profiles).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*docs.columns)


@register("op7_rank_order_language")
def op7_rank_order_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; learned from text and lang of the documents that are not held out."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    profiles = learn(docs.filter(~held_out()).select("text", "lang"))
    out = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles)
    return out.select("doc_id", "held_out", "lang_pred", "score")
