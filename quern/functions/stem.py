"""English stems by Porter's suffix rules, made where the words are; a worker remembers many.

A word is read as consonants and vowels, [C](VC){m}[V]; m is its measure. Five steps take suffixes away, each under a condition on the
measure or the vowels of what stays before the suffix.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The suffixes of steps 2, 3 and 4 and what takes their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel behind a consonant."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and k and out[-1] == "c") else "c"
    return out


def measure(word: str) -> int:
    shape = _shape(word)
    return sum(a == "v" and b == "c" for a, b in zip(shape, shape[1:]))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a word in lower case; words of up to two letters, and with other letters than a to z, stay."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    # 1a: plurals.
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: past and progressive.
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    else:
        suffix = _longest(word, ("ed", "ing"))
        if suffix and "v" in _shape(word[: -len(suffix)]):
            word = word[: -len(suffix)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif measure(word) == 1 and _short(word):
                word += "e"
    # 1c
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        suffix = _longest(word, table)
        if suffix and measure(word[: -len(suffix)]):
            word = word[: -len(suffix)] + table[suffix]
    suffix = _longest(word, STEP_4)
    if suffix:
        rest = word[: -len(suffix)]
        if measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
            word = rest
    # 5: a last e, a double l.
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or (measure(rest) == 1 and not _short(rest)):
            word = rest
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


@lru_cache(1 << 18)
def _known(word: str) -> str:
    """stem; a worker keeps the stems of the words it met last."""
    return stem(word)


def stems(words: Column) -> Column:
    """The stems of an array of words, in their order."""

    @F.arrow_udf("array<string>")
    def rule(lists: pa.Array) -> pa.Array:
        return pa.array([None if own is None else [_known(w) for w in own] for own in lists.to_pylist()], pa.list_(pa.string()))

    return rule(words)


def stemmed(terms: DataFrame, column: str = "term") -> DataFrame:
    """terms with the column `stem` beside every term, made where the term is; null terms are left out."""
    rows = terms.where(F.col(column).isNotNull())
    return rows.withColumn("stem", stems(F.array(column))[0])
