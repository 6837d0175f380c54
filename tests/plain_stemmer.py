"""Plain stemmer, against which the column expressions are tested."""

from textpulse.functions.stemmer import IRREGULAR, STEP2, STEP3, STEP4


def _shape(word: str) -> str:
    """One letter per character: c for consonant, v for vowel (y follows its neighbour)."""
    out = []
    for ch in word:
        if ch in "aeiou" or (ch == "y" and out and out[-1] == "c"):
            out.append("v")
        else:
            out.append("c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _closed(stem: str) -> bool:
    """Ends consonant-vowel-consonant (last not w, x, y), or is vowel-consonant."""
    shape = _shape(stem)
    if len(stem) == 2:
        return shape == "vc"
    return shape.endswith("cvc") and stem[-1] not in "wxy"


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _closed(stem) else stem
    return word


def _final_y(word: str) -> str:
    if word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "c":
        return word[:-1] + "i"
    return word


def _replace(word: str, rules: list[tuple[str, str]]) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


def _double(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _double(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _replace(word, STEP2)


def _drop(word: str) -> str:
    for suffix in STEP4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if suffix == "ion" and not stem.endswith(("s", "t")):
                return word
            return stem if _measure(stem) > 1 else word
    return word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _closed(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def porter(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _final_y(_past(_plural(word)))
    return _tidy(_drop(_replace(_double(word), STEP3)))
