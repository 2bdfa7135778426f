"""Folded and stemmed terms: what the stored index matches by.

Folding is an expression: lower case, Latin letters without their marks, runs of letters and digits of any
script. Stemming (Porter's algorithm of 1980) runs over distinct terms only, in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _marked() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters with marks, and their bases."""
    found = [(c, b) for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]) if c.islower() and len(b := "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))) == 1 and b != c]
    return "".join(c for c, _ in found), "".join(b for _, b in found)


FROM, TO = _marked()


def folded_tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, lower-cased, marks folded; null as empty."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), FROM, TO)
    return F.regexp_extract_all(F.regexp_replace(low, r"\p{Mn}+", ""), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """Each letter as v or c; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, ends: dict[str, str], least: int) -> str:
    """The longest of the endings is replaced if what is before it measures more than `least`."""
    for end in sorted((e for e in ends if word.endswith(e)), key=len, reverse=True):
        base = word[: len(word) - len(end)]
        return base + ends[end] if _measure(base) > least else word
    return word


def porter(word: str) -> str:
    """The stem of a lower-case English word; words with other than a-z, and of up to two letters, are their own."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            base = word[: -len(end)]
            if word.endswith(end) and "v" in _shape(base):
                word = base
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2, 0), _STEP3, 0)
    ends = dict.fromkeys(_STEP4, "")
    if word.endswith("ion"):
        if word[-4:-3] in ("s", "t") and word[:-3] and _measure(word[:-3]) > 1:
            word = word[:-3]
    else:
        word = _swap(word, ends, 1)
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _short_end(base):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else porter(w))


def with_stems(rows: DataFrame, term: str = "term") -> DataFrame:
    """rows with `stem`: each distinct term is stemmed once and joined back."""
    known = rows.select(term).distinct().withColumn("stem", stem(F.col(term)))
    return rows.join(known, term)
