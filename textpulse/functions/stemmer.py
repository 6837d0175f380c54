"""Porter stemming (Porter 1980, with the usual later extensions) as an expression over a token column.

The rules are written once, as SQL, for Spark and for the engine that checks it; a ``Dialect`` says how each binds a
name to a value, so that every step is worked out once however often it is used.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words whose stem the rules would get wrong.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
# Suffix rules of steps 2, 3 and 4.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
]
STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
    ("ness", ""),
]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]


@dataclass(frozen=True)
class Dialect:
    bind: str  # value, name, body -> the body with the name standing for the value
    replace: str  # all matches of a pattern


SPARK = Dialect("transform(array({value}), {name} -> {body})[0]", "regexp_replace({text}, '{pattern}', '{new}')")
DUCKDB = Dialect("list_transform([{value}], lambda {name}: {body})[1]", "regexp_replace({text}, '{pattern}', '{new}', 'g')")


class _Rules:
    """SQL of the steps; each takes and gives the SQL of a word."""

    def __init__(self, dialect: Dialect):
        self.dialect, self.names = dialect, 0

    def let(self, value: str, body: Callable[[str], str]) -> str:
        self.names += 1
        name = f"w{self.names}"
        return "(" + self.dialect.bind.format(value=value, name=name, body=body(name)) + ")"

    def replaced(self, text: str, *rules: tuple[str, str]) -> str:
        for pattern, new in rules:
            if self.dialect is DUCKDB:
                new = new.replace("$", "\\")
            text = self.dialect.replace.format(text=text, pattern=pattern, new=new)
        return text

    def shape(self, word: str) -> str:
        """One digit per character: 1 for a vowel, 0 for a consonant; y follows its neighbour."""
        marked = self.replaced(f"translate({word}, '1Y', '00')", ("(^|[aeiou])y", "$1Y"), ("yy", "yY"))
        return self.replaced(marked, ("[aeiouy]", "1"), ("[^1]", "0"))

    @staticmethod
    def ends(word: str, suffix: str) -> str:
        return f"right({word}, {len(suffix)}) = '{suffix}'"

    @staticmethod
    def cut(word: str, n: int) -> str:
        return f"substring({word}, 1, length({word}) - {n})"

    @staticmethod
    def case(*branches: tuple[str, str], other: str) -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {other} END"

    @staticmethod
    def closed(word: str, shape: str) -> str:
        """Ends consonant-vowel-consonant (last not w, x, y), or is vowel-consonant."""
        longer = f"right({shape}, 3) = '010' AND right({word}, 1) NOT IN ('w', 'x', 'y')"
        return f"CASE WHEN length({word}) = 2 THEN {shape} = '10' ELSE {longer} END"

    @staticmethod
    def measured(shape: str) -> str:
        """The measure is above 0; ``long`` says whether it is above 1."""
        return f"contains({shape}, '10')"

    @staticmethod
    def long(shape: str) -> str:
        return f"{shape} LIKE '%10%10%'"

    def plural(self, w: str) -> str:
        return self.case(
            (self.ends(w, "ies"), self.case((f"length({w}) = 4", self.cut(w, 1)), other=self.cut(w, 2))),
            (self.ends(w, "sses"), self.cut(w, 2)),
            (f"{self.ends(w, 's')} AND NOT {self.ends(w, 'ss')}", self.cut(w, 1)),
            other=w,
        )

    def _after_past(self, stem: str) -> str:
        def tidy(s: str, h: str) -> str:
            double = f"length({s}) > 1 AND right({s}, 1) = substring({s}, length({s}) - 1, 1) AND right({h}, 1) = '0'"
            return self.case(
                (f"right({s}, 2) IN ('at', 'bl', 'iz')", f"concat({s}, 'e')"),
                (double, self.case((f"right({s}, 1) IN ('l', 's', 'z')", s), other=self.cut(s, 1))),
                (f"{self.measured(h)} AND NOT ({self.long(h)}) AND ({self.closed(s, h)})", f"concat({s}, 'e')"),
                other=s,
            )

        return self.let(stem, lambda s: self.let(self.shape(s), lambda h: tidy(s, h)))

    def past(self, w: str) -> str:
        vowel = lambda n: f"contains({self.shape(self.cut(w, n))}, '1')"
        return self.case(
            (self.ends(w, "ied"), self.case((f"length({w}) = 4", self.cut(w, 1)), other=self.cut(w, 2))),
            (self.ends(w, "eed"), self.case((self.measured(self.shape(self.cut(w, 3))), self.cut(w, 1)), other=w)),
            (f"{self.ends(w, 'ed')} AND {vowel(2)}", self._after_past(self.cut(w, 2))),
            (f"{self.ends(w, 'ing')} AND {vowel(3)}", self._after_past(self.cut(w, 3))),
            other=w,
        )

    def final_y(self, w: str) -> str:
        before = f"substring({self.shape(w)}, length({w}) - 1, 1) = '0'"
        return self.case((f"{self.ends(w, 'y')} AND length({w}) > 2 AND {before}", f"concat({self.cut(w, 1)}, 'i')"), other=w)

    def rules(self, w: str, rules: Sequence[tuple[str, str]]) -> str:
        def one(suffix: str, new: str) -> tuple[str, str]:
            stem = self.cut(w, len(suffix))
            return self.ends(w, suffix), self.case((self.measured(self.shape(stem)), f"concat({stem}, '{new}')"), other=w)

        return self.case(*(one(s, n) for s, n in rules), other=w)

    def double(self, w: str) -> str:
        alli = self.case((f"{self.ends(w, 'alli')} AND {self.measured(self.shape(self.cut(w, 4)))}", self.cut(w, 2)), other=w)

        def rest(v: str) -> str:
            logi = self.case((self.measured(self.shape(self.cut(v, 3))), self.cut(v, 1)), other=v)
            return self.case((self.ends(v, "logi"), logi), other=self.rules(v, STEP2))

        return self.let(alli, rest)

    def drop(self, w: str) -> str:
        def one(suffix: str) -> tuple[str, str]:
            stem = self.cut(w, len(suffix))
            gone = self.long(self.shape(stem))
            if suffix == "ion":
                gone = f"right({stem}, 1) IN ('s', 't') AND {gone}"
            return self.ends(w, suffix), self.case((gone, stem), other=w)

        return self.case(*(one(s) for s in STEP4), other=w)

    def tidy(self, w: str) -> str:
        def without_e(s: str, h: str) -> str:
            gone = f"{self.long(h)} OR ({self.measured(h)} AND NOT ({self.closed(s, h)}))"
            return self.case((gone, s), other=w)

        shorter = self.let(self.cut(w, 1), lambda s: self.let(self.shape(s), lambda h: without_e(s, h)))
        first = self.case((self.ends(w, "e"), shorter), other=w)
        return self.let(first, lambda v: self.case((f"{self.ends(v, 'll')} AND {self.long(self.shape(self.cut(v, 1)))}", self.cut(v, 1)), other=v))

    def stem(self, token: str) -> str:
        steps = (self.plural, self.past, self.final_y, self.double, lambda w: self.rules(w, STEP3), self.drop, self.tidy)

        def chain(w: str, rest: Sequence[Callable[[str], str]]) -> str:
            return self.let(rest[0](w), lambda v: chain(v, rest[1:])) if rest else w

        known = [(f"{{w}} = '{k}'", f"'{v}'") for k, v in IRREGULAR.items()]

        def word(w: str) -> str:
            irregular = [(c.format(w=w), v) for c, v in known]
            return self.case(*irregular, (f"length({w}) <= 2", w), other=chain(w, steps))

        return self.let(f"lower({token})", word)


def stem_sql(token: str, dialect: Dialect = DUCKDB) -> str:
    """SQL of the stem of the token that ``token`` is the SQL of."""
    return _Rules(dialect).stem(token)


def porter_stem(token: str = "token") -> Column:
    """Stem of the column named ``token``; give it distinct tokens."""
    return F.expr(stem_sql(f"`{token}`", SPARK))
