"""Porter's stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980), as full-text indexes apply it.

Tokens of under 3 or over 64 bytes are left alone; bytes beyond ASCII count as consonants."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The paper's suffixes and replacements of steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out: list[str] = []
    for i, letter in enumerate(stem):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _ends_cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s) and len(word) > len(s)), key=len, default=None)


def _plural(word: str) -> str:
    if (word.endswith("sses") and len(word) > 4) or (word.endswith("ies") and len(word) > 3):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if "v" not in _shape(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c" and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _ends_cvc(stem) else stem
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    raw = word.encode()
    if not 3 <= len(raw) <= 64:
        return word
    return _stem(raw.decode("latin-1")).encode("latin-1").decode("utf-8", "replace")


def _stem(word: str) -> str:
    """word: a character for each byte."""
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        suffix = _longest(word, table)
        if suffix and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + table[suffix]
    suffix = _longest(word, STEP_4)
    if suffix:
        rest = word[: -len(suffix)]
        if _measure(rest) > 1 and (suffix != "ion" or rest[-1] in "st"):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _ends_cvc(rest)):
            word = rest
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.StringType())
def stemmed(phrase: pd.Series) -> pd.Series:
    """Phrases of terms with a space between them, each term stemmed; each distinct phrase of a batch once."""
    codes, distinct = pd.factorize(phrase)
    return pd.Series([" ".join(map(stem, p.split(" "))) for p in distinct], dtype=object).take(codes).reset_index(drop=True) if len(distinct) else phrase
