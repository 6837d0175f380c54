"""Tokenizers: functions from a text column to an ``ARRAY<STRING>`` column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]

# Token patterns shared by Java and RE2 regular expressions.
WORD_OR_MARK = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
WORD_OF_TWO = r"([\p{L}\p{N}_]{2,})"
NON_SPACE = r"(\S+)"

# Penn Treebank style rewriting rules (pattern, replacement with
# $n groups), applied in this order to one sentence per line.
TREEBANK_RULES = [
    # opening quotes
    (r"([«“‘„]|[`]+)", r" $1 "),
    (r'(?m)^"', r"``"),
    (r"(``)", r" $1 "),
    (r"([ (\[{<])(\"|'')", r"$1 `` "),
    (r"(?i)(')([a-ce-lo-ru-z0-9_])\b", r"$1 $2"),
    # punctuation
    (r"(?m)([^.])(\.)([\])}>\"'»”’ ]*) *$", r"$1 $2 $3 "),
    (r"([:,])([^0-9])", r" $1 $2"),
    (r"(?m)([:,])$", r" $1 "),
    (r"(\.{2,})", r" $1 "),
    (r"([;@#$%&])", r" $1 "),
    (r"([?!])", r" $1 "),
    (r"([^'])' ", r"$1 ' "),
    (r"([*])", r" $1 "),
    # brackets and dashes
    (r"([\]\[(){}<>])", r" $1 "),
    (r"(--)", r" $1 "),
    # closing quotes
    (r"([»”’])", r" $1 "),
    (r"('')", r" $1 "),
    (r'(")', r" '' "),
    (r"([^' ])('[sSmMdD]|') ", r"$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"$1 $2 "),
    # contractions
    (r"(?i)\b(?:(can)(not)|(d)('ye)|(gim)(me)|(gon)(na))\b", r" $1$3$5$7 $2$4$6$8 "),
    (r"(?i)\b(?:(got)(ta)|(lem)(me)|(more)('n)|(wan)(na))\b", r" $1$3$5$7 $2$4$6$8 "),
    (r"(?i) ('t)(is|was)\b", r" $1 $2 "),
]
# For each rule, strings of which a line must hold one to be changed by it; those of rules that disregard
# case are looked for in lower case.
TREEBANK_MARKS = [
    "« “ ‘ „ `", '"', "``", "\" ''", "'", ".", ": ,", ": ,", "..", "; @ # $ % &", "? !", "'", "*", "[ ] ( ) { } < >", "--",
    "» ” ’", "''", '"', "'", "'", "cannot d'ye gimme gonna", "gotta lemme more'n wanna", "'",
]
# A sentence ends at . ? or ! (with closing marks) before a capital letter.
SENTENCE_END = r"([.?!][\])}\"'»”’]*)[ ]+([\p{Lu}])"


def word_marks(text: Column) -> Column:
    """Runs of word characters, or single marks."""
    return F.regexp_extract_all(text, F.lit(WORD_OR_MARK), F.lit(1))


def _replaced(line: Column, pattern: str, replacement: str, marks: list[str]) -> Column:
    """``regexp_replace`` of lines that hold one of ``marks``; a search for them costs far less than the pattern."""

    def one(x: Column) -> Column:
        seen = F.lower(x) if marks[0].isalpha() else x
        found = reduce(lambda a, b: a | b, [F.contains(seen, F.lit(m)) for m in marks])
        return F.when(found, F.regexp_replace(x, pattern, replacement)).otherwise(x)

    # A variable keeps the line from being worked out for each of its uses.
    return F.get(F.transform(F.array(line), one), 0)


def treebank(text: Column) -> Column:
    """Treebank style tokens: contractions, quotes and final periods split off."""
    line = F.regexp_replace(text, r"\s+", " ")
    line = F.regexp_replace(line, SENTENCE_END, "$1\n$2")
    line = F.regexp_replace(line, r"\n", " \n ")
    line = F.concat(F.lit(" "), line, F.lit(" "))
    line = F.regexp_replace(line, r"(?m)^ +", "")
    for (pattern, replacement), marks in zip(TREEBANK_RULES, TREEBANK_MARKS, strict=True):
        line = _replaced(line, pattern, replacement, marks.split(" "))
    return F.regexp_extract_all(line, F.lit(NON_SPACE), F.lit(1))


def whitespace(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.regexp_extract_all(text, F.lit(NON_SPACE), F.lit(1))


def words(text: Column) -> Column:
    """Lower-cased words of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_OF_TWO), F.lit(1))


def characters(text: Column) -> Column:
    """The characters of a text as an array."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def _ngrams(parts: Column, n: int, joined: Callable[[list[Column]], Column]) -> Column:
    """Runs of ``n`` neighbours of an array; each takes constant time, wherever it lies."""
    starts = F.when(F.size(parts) >= n, F.sequence(F.lit(0), F.size(parts) - F.lit(n)))
    starts = F.coalesce(starts, F.array().cast("array<int>"))
    return F.transform(starts, lambda i: joined([F.get(parts, i + k) for k in range(n)]))


def char_ngrams(chars: Column, n: int) -> Column:
    """All n-grams of a character array; none for shorter texts."""
    return _ngrams(chars, n, lambda parts: F.concat(*parts))


def folded_text(text: Column) -> Column:
    """Lower case with every run of white space as one space."""
    return F.regexp_replace(F.lower(text), r"\s+", " ")


def word_ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array."""
    return _ngrams(tokens, n, lambda parts: F.concat_ws(" ", *parts))


def restore_case(stem: Column, token: Column) -> Column:
    """Give a lower-cased stem the capitals its token has at the same positions."""
    chars = F.zip_with(
        F.split(stem, ""),
        F.slice(F.split(token, ""), F.lit(1), F.length(stem)),
        lambda s, t: F.when((s != t) & (F.upper(s) == t), t).otherwise(s),
    )
    return F.when(stem == token, stem).otherwise(F.array_join(chars, ""))
