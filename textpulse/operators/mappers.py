"""Series mappers: texts to language time series (doc_id, method, t, value)."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.functions import text as tx
from textpulse.operators import tokens as tk
from textpulse.operators import vocab as vc
from textpulse.operators.lookup import looked_up
from textpulse.operators.tokens import one_task_per_text
from textpulse.session import checkpointed, stored

SERIES = ["doc_id", "method", "t", "value"]


class SeriesMapper(ABC):
    """Maps documents to series; ``fit`` learns what depends on the training texts."""

    name: str
    depends_on_corpus = False

    def fit(self, docs: DataFrame) -> SeriesMapper:
        return self

    @abstractmethod
    def transform(self, docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """(``keep``..., method, t, value); ``keep`` defaults to doc_id."""

    def fit_transform(self, docs: DataFrame) -> DataFrame:
        """The series of the training texts themselves."""
        return self.fit(docs).transform(docs)

    def fitted_data(self) -> dict[str, DataFrame]:
        """Fitted tables by name, as stored and restored with the model."""
        return {}

    def restore(self, data: dict[str, DataFrame]) -> SeriesMapper:
        """Take fitted tables read from a store."""
        return self

    def fold_series(self, docs: DataFrame, folds: DataFrame, k: int) -> DataFrame:
        """(fold, doc_id, method, t, value) of all documents, fitted on each fold's training side."""
        raise NotImplementedError(f"{self.name} does not depend on the training texts")

    def _series(self, rows: DataFrame, keep: list[str], t: Column, value: Column) -> DataFrame:
        return rows.select(
            *keep, F.lit(self.name).alias("method"), t.cast("int").alias("t"), value.cast("double").alias("value")
        )


class CorpusIndependentMapper(SeriesMapper):
    """Needs no training texts."""


class CorpusDependentMapper(SeriesMapper):
    """Must be fitted on the training texts."""

    depends_on_corpus = True
    tokenizer: tx.Tokenizer

    def _cut(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """(``keep``..., tokens) of whole texts, stored: tokenising costs more than reading the tokens again."""
        return stored(one_task_per_text(docs, keep).select(*keep, self.tokenizer(F.col("text")).alias("tokens")), "tokens")

    def _learn(self, token_rows: DataFrame) -> None:
        """Fit on (doc_id, pos, token)."""
        raise NotImplementedError

    def _applied(self, cut: DataFrame, keep: list[str]) -> DataFrame:
        """The series of :meth:`_cut` texts."""
        raise NotImplementedError

    def fit(self, docs):
        self._learn(tk.tokens(docs, self.tokenizer))
        return self

    def transform(self, docs, keep=None):
        keep = keep or ["doc_id"]
        return self._applied(self._cut(docs, keep), keep)

    def fit_transform(self, docs):
        """The texts are tokenised once for both."""
        cut = self._cut(docs, ["doc_id"])
        self._learn(tk.tokens(cut, _as_cut, text="tokens"))
        return self._applied(cut, ["doc_id"])


def _as_cut(tokens: Column) -> Column:
    """Tokenizer of texts that are cut already."""
    return tokens


class TokenLengthSequence(CorpusIndependentMapper):
    """The length of every token; a single 0 for a text without tokens."""

    def __init__(self, name: str = "tokenlenseq", tokenizer: tx.Tokenizer = tx.treebank):
        self.name, self.tokenizer = name, tokenizer

    def transform(self, docs, keep=None):
        keep = keep or ["doc_id"]
        lengths = F.transform(self.tokenizer(F.col("text")), F.length)
        rows = one_task_per_text(docs, keep).select(*keep, F.posexplode_outer(lengths).alias("pos", "len"))
        return self._series(rows, keep, F.coalesce("pos", F.lit(0)), F.coalesce("len", F.lit(0)))


class TokenLengthDistribution(CorpusIndependentMapper):
    """Share of tokens of each length 1..max_length among all tokens."""

    def __init__(
        self, name: str = "tokenlendist", max_length: int = 14, tokenizer: tx.Tokenizer = tx.treebank
    ):
        self.name, self.max_length, self.tokenizer = name, max_length, tokenizer

    def transform(self, docs, keep=None):
        keep = keep or ["doc_id"]
        lengths = F.transform(self.tokenizer(F.col("text")), F.length)
        rows = one_task_per_text(docs, keep).select(*keep, lengths.alias("lens"))
        shares = F.transform(
            F.sequence(F.lit(1), F.lit(self.max_length)),
            lambda k: F.when(F.size("lens") == 0, F.lit(0.0)).otherwise(
                F.size(F.filter("lens", lambda x: x == k)) / F.size("lens")
            ),
        )
        return self._series(rows.select(*keep, F.posexplode(shares).alias("pos", "share")), keep, F.col("pos"), F.col("share"))


class _VocabularyMapper(CorpusDependentMapper):
    """Shared lookup of tokens in a fitted (token, value) table with a default."""

    def __init__(self, name: str, tokenizer: tx.Tokenizer, stem_mode: str):
        self.name, self.tokenizer, self.stem_mode = name, tokenizer, stem_mode
        self.vocab: DataFrame | None = None

    def fitted_data(self):
        return {"vocab": self.vocab}

    def restore(self, data):
        self.vocab = data["vocab"]
        return self

    def _values(self) -> tuple[DataFrame, Column]:
        """(token, v, _freq) and the value of an unseen token."""
        raise NotImplementedError

    def transform(self, docs, keep=None):
        if self.vocab is None:
            raise ValueError(f"{self.name} is not fitted")
        return super().transform(docs, keep)

    def _applied(self, cut, keep):
        rows = tk.tokens_or_mark(cut, _as_cut, keep, "tokens")
        values, default = self._values()
        if self.stem_mode in ("identity", "lower"):
            token = F.lower("token") if self.stem_mode == "lower" else F.col("token")
            found = looked_up(rows.withColumn("token", token), values, ["token"], "_freq", "left", home=keep[0])
        else:
            # Stem each distinct token once, look the stem up, and bring the value back.
            seen = tk.counted_stems(rows.filter("pos is not null"), self.stem_mode)
            known = checkpointed(seen.join(values.select(F.col("token").alias("stem"), "v"), "stem").select("token", "v", "_freq"))
            found = looked_up(rows, known, ["token"], "_freq", "left", home=keep[0])
        value = F.when(F.col("pos").isNull(), F.lit(0.0)).otherwise(F.log1p(F.coalesce("v", default)))
        return self._series(found, keep, F.coalesce("pos", F.lit(0)), value)

    def _fold_values(self, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(fold, token, v) and (fold, v) for unseen tokens, from the training vocabularies."""
        raise NotImplementedError

    def fold_series(self, docs, folds, k):
        cut = self._cut(docs, ["doc_id"])
        rows = tk.tokens_or_mark(cut, _as_cut, text="tokens")
        stems = tk.counted_stems(rows.filter("pos is not null"), self.stem_mode)
        placed = cut.join(folds.select("doc_id", "fold"), "doc_id")
        counted = vc.vocabulary(tk.tokens(placed, _as_cut, ["doc_id", "fold"], "tokens"), self.stem_mode, ("fold",))
        values, unseen = self._fold_values(checkpointed(vc.training_vocabularies(counted, k)))
        # One row per token with its value in every fold: the join carries each token once.
        listed = values.groupBy(F.col("token").alias("stem")).agg(
            F.map_from_entries(F.collect_list(F.struct("fold", "v"))).alias("vs")
        )
        known = stored(stems.join(listed, "stem").select("token", "vs", "_freq"), "fold-values")
        default = unseen.agg(F.map_from_entries(F.collect_list(F.struct("fold", "v")))).scalar()
        found = looked_up(rows, known, ["token"], "_freq", "left").withColumn("ds", default)
        spread = found.select("*", F.explode(F.array(*[F.lit(f) for f in range(k)])).alias("fold"))
        v = F.coalesce(F.try_element_at("vs", F.col("fold")), F.try_element_at("ds", F.col("fold")))
        value = F.when(F.col("pos").isNull(), F.lit(0.0)).otherwise(F.log1p(v))
        return self._series(spread, ["fold", "doc_id"], F.coalesce("pos", F.lit(0)), value)


class TokenFrequencySequence(_VocabularyMapper):
    """ln(1 + corpus count) of every stem; unseen stems give 0."""

    def __init__(
        self, name: str = "tokenfreqseq", tokenizer: tx.Tokenizer = tx.treebank, stem_mode: str = "porter_case"
    ):
        super().__init__(name, tokenizer, stem_mode)

    def _learn(self, token_rows):
        self.vocab = checkpointed(vc.vocabulary(token_rows, self.stem_mode))

    def _values(self):
        return self.vocab.select("token", F.col("freq").alias("v"), F.col("freq").alias("_freq")), F.lit(0)

    def _fold_values(self, vocab):
        values = vocab.select("fold", "token", F.col("freq").alias("v"))
        return values, values.select("fold").distinct().withColumn("v", F.lit(0).cast("bigint"))


class TokenRankSequence(_VocabularyMapper):
    """ln(1 + frequency rank) of every stem; unseen stems rank after the last."""

    def __init__(
        self, name: str = "tokenrankseq", tokenizer: tx.Tokenizer = tx.treebank, stem_mode: str = "porter_case"
    ):
        super().__init__(name, tokenizer, stem_mode)

    def _learn(self, token_rows):
        # The sort of the ranks reads its input twice.
        self.vocab = vc.ranked(checkpointed(vc.vocabulary(token_rows, self.stem_mode)))

    def _values(self):
        values = self.vocab.select("token", F.col("rank").alias("v"), F.col("freq").alias("_freq"))
        return values, vc.max_rank(self.vocab).scalar() + 1

    def _fold_values(self, vocab):
        values = vc.ranked(vocab, ["fold"]).select("fold", "token", F.col("rank").alias("v"))
        return values, values.groupBy("fold").agg((F.max("v") + 1).alias("v"))


class TokenRankDistribution(CorpusDependentMapper):
    """Counts of the ``length`` most frequent stems, in token order, zeros included."""

    def __init__(
        self,
        name: str = "tokenrankdist",
        length: int = 1000,
        tokenizer: tx.Tokenizer = tx.words,
        stem_mode: str = "porter",
    ):
        self.name, self.length, self.tokenizer, self.stem_mode = name, length, tokenizer, stem_mode
        self.top: DataFrame | None = None

    def _learn(self, token_rows):
        vocab = vc.vocabulary(token_rows, self.stem_mode)
        self.top = checkpointed(vc.top_vocabulary(vocab, self.length).select("token", "t"))

    def fitted_data(self):
        return {"top": self.top}

    def restore(self, data):
        self.top = data["top"]
        return self

    def transform(self, docs, keep=None):
        if self.top is None:
            raise ValueError(f"{self.name} is not fitted")
        return super().transform(docs, keep)

    def _applied(self, cut, keep):
        rows = tk.tokens(cut, _as_cut, keep, "tokens")
        top = F.broadcast(self.top)  # at most `length` rows
        if self.stem_mode in ("identity", "lower"):
            placed = tk.stemmed(rows, self.stem_mode).join(top, "token")
        else:
            seen = tk.counted_stems(rows, self.stem_mode)
            places = checkpointed(seen.join(top.withColumnRenamed("token", "stem"), "stem").select("token", "t", "_freq"))
            placed = looked_up(rows, places, ["token"], "_freq", home=keep[0])
        size = self.top.agg(F.count(F.lit(1)).cast("int")).scalar()
        return self._dense(cut.select(*keep).withColumn("size", size), placed, keep)

    def fold_series(self, docs, folds, k):
        cut = self._cut(docs, ["doc_id"])
        rows = tk.tokens(cut, _as_cut, text="tokens")
        placed = cut.join(folds.select("doc_id", "fold"), "doc_id")
        counted = vc.vocabulary(tk.tokens(placed, _as_cut, ["doc_id", "fold"], "tokens"), self.stem_mode, ("fold",))
        vocab = checkpointed(vc.training_vocabularies(counted, k))
        top = checkpointed(vc.top_vocabulary(vocab, self.length, ["fold"]).select("fold", "token", "t"))
        listed = top.groupBy(F.col("token").alias("stem")).agg(F.collect_list(F.struct("fold", "t")).alias("ts"))
        stems = tk.counted_stems(rows, self.stem_mode)
        places = stored(stems.join(listed, "stem").select("token", "ts", "_freq"), "places")
        found = looked_up(rows, places, ["token"], "_freq").select("doc_id", F.inline("ts"))
        sizes = top.groupBy("fold").agg(F.count(F.lit(1)).cast("int").alias("size"))
        every = cut.select("doc_id", F.explode(F.array(*[F.lit(f) for f in range(k)])).alias("fold"))
        return self._dense(every.join(F.broadcast(sizes), "fold"), found, ["fold", "doc_id"])

    def _dense(self, wanted: DataFrame, placed: DataFrame, keep: list[str]) -> DataFrame:
        """Zero-filled series of ``wanted`` (keep..., size), built per document from its non-zero entries.

        The gaps between entries are filled, which takes one pass, where a look into a map for every place would take many.
        """
        counts = placed.groupBy(*keep, "t").agg(F.count(F.lit(1)).alias("n"))
        entries = counts.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("es"))
        empty = F.array().cast("array<struct<t:int,n:bigint>>")
        end = F.array(F.struct(F.col("size").alias("t"), F.lit(0).cast("bigint").alias("n")))
        dense = wanted.join(entries, keep, "left").withColumn("es", F.concat(F.coalesce("es", empty), end))
        gap = lambda e, i: F.array_repeat(F.lit(0).cast("bigint"), e["t"] - F.coalesce(F.get("es", i - 1)["t"], F.lit(-1)) - 1)
        filled = F.flatten(F.transform("es", lambda e, i: F.concat(gap(e, i), F.array(e["n"]))))
        # Without any vocabulary a series has two zeros.
        places = F.greatest(F.col("size"), F.when(F.col("size") == 0, F.lit(2)).otherwise(F.lit(1)))
        values = F.slice(F.concat(filled, F.array(F.lit(0).cast("bigint"))), 1, places)
        return self._series(dense.select(*keep, F.posexplode(values).alias("pos", "n")), keep, F.col("pos"), F.col("n"))


def default_mappers() -> list[SeriesMapper]:
    return [
        TokenLengthSequence(),
        TokenFrequencySequence(),
        TokenRankSequence(),
        TokenLengthDistribution(),
        TokenRankDistribution(),
    ]
