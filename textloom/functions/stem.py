"""Porter's stemming algorithm (Program 14, 1980), with the later changes bli -> ble and logi -> log.

Written from the published description: a word is a chain of consonant and vowel runs, its measure m the
number of vowel-consonant changes; steps 1a to 5b replace endings under conditions on the part before.
Words of one or two letters, and upper-case letters, are not touched (capitals count as consonants).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The endings of steps 2, 3 and 4 in the published order.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or letter == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _by_longest(word: str, table: dict[str, str], least: int) -> str:
    for ending in sorted(table, key=len, reverse=True):
        if word.endswith(ending):
            stem = word[: len(word) - len(ending)]
            return stem + table[ending] if measure(stem) > least else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    # 1a: plurals
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: past and continuous forms
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((len(e) for e in ("ed", "ing") if word.endswith(e) and _has_vowel(word[: -len(e)])), 0)
        if cut:
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _doubled(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif measure(word) == 1 and _short_end(word):
                word += "e"
    # 1c
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _by_longest(word, STEP_2, 0)
    word = _by_longest(word, STEP_3, 0)
    for ending in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(ending):
            rest = word[: len(word) - len(ending)]
            if measure(rest) > 1 and (ending != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    # 5: a final e, and a doubled l
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or measure(rest) == 1 and not _short_end(rest):
            word = rest
    if measure(word) > 1 and word.endswith("ll"):
        word = word[:-1]
    return word


def stem_column(word: Column) -> Column:
    @F.pandas_udf("string")
    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield words.map(lambda w: None if w is None else stem(w))

    return stems(word)


def stemmed_vocabulary(words: DataFrame) -> DataFrame:
    """term, stem of each distinct term of a one-column table: the stemmer runs once per term."""
    return words.select(F.col(words.columns[0]).alias("term")).distinct().withColumn("stem", stem_column(F.col("term")))
