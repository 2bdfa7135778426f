"""String functions as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NUMBER = r"^\d+(\.\d+)?$"


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text; null as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """Compatibility composition; ASCII texts are already composed."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), _nfkc(text)).otherwise(text)


def squeeze(text: Column) -> Column:
    """White space runs (of any script) as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    return squeeze(nfkc(text))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def text_hash(text: Column) -> Column:
    """16 bytes of MD5."""
    return F.unhex(F.md5(text))


def file_uid(path: Column) -> Column:
    return F.concat(F.lit("f_"), F.md5(path))


def grams(words: Column, n: int, longer_than: int = 0) -> Column:
    """The n-word phrases of an array of words that have more than so many characters."""
    made = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.filter(made, lambda p: F.length(p) > longer_than)


def phrases(query: Column) -> Column:
    """Quoted phrases, and two- and three-word phrases of some length; distinct, sorted."""
    quoted = [F.regexp_extract_all(query, F.lit(p), F.lit(1)) for p in ('"([^"]+)"', "'([^']+)'", "‘([^’]+)’", "“([^”]+)”")]
    words = tokens(query)
    return F.array_sort(F.array_distinct(F.concat(*quoted, grams(words, 2, 5), grams(words, 3, 8))))


def by_length(words: Column) -> Column:
    """Distinct words, longest first, then by name."""
    keyed = F.transform(F.array_distinct(words), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    return F.transform(F.array_sort(keyed), lambda s: s["w"])


def keywords(query: Column, df: Column | None = None, total: Column | None = None, max_terms: int = 16) -> Column:
    """Search terms: numbers first, then content words (three letters or more), longest first.

    Beyond six content words without quotes, words in more than max(15 %, 50) documents go unless a phrase
    holds them (df: map of word to documents), and at most 12 words stay up to 12 content words.
    """
    words = tokens(query)
    numbers = F.filter(words, lambda t: t.rlike(NUMBER))
    content = F.filter(words, lambda t: ~t.rlike(NUMBER) & (F.length(t) > 2))
    quotes = query.rlike("[\"'‘’]")
    short = (F.size(content) <= 6) | quotes
    kept = content
    if df is not None:
        inside = F.flatten(F.transform(phrases(query), tokens))
        limit = F.greatest(total * 0.15, F.lit(50.0))
        kept = F.filter(content, lambda t: F.array_contains(inside, t) | (F.coalesce(df[t], F.lit(0)) < limit))
    most = F.when(short | (F.size(content) > 12), max_terms).otherwise(12)
    return F.array_distinct(F.concat(numbers, F.slice(by_length(F.when(short, content).otherwise(kept)), F.lit(1), most)))


def snippet(text: Column, words: Column, max_chars: int = 280) -> Column:
    """The sentence that holds most query words, one before and two after it, cut at a space."""
    parts = F.split(text, r"(?<=[.!?])\s+")
    score = F.transform(parts, lambda s: F.size(F.filter(F.array_distinct(words), lambda w: F.contains(F.lower(s), w))))
    best = F.array_position(score, F.array_max(score)).cast("int")
    out = F.array_join(F.slice(parts, F.greatest(best - 1, F.lit(1)), F.least(best + 2, F.size(parts)) - F.greatest(best - 1, F.lit(1)) + 1), " ")
    cut = F.substring(out, 1, max_chars)
    return F.when(F.length(out) > max_chars, F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("…"))).otherwise(out)


def matches_none(text: Column, patterns: list[str]) -> Column:
    """No pattern is found in the text; without patterns, true."""
    return ~reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns)) if patterns else F.lit(True)


def extension_filter(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Case-insensitive suffix test; what is excluded is not included, and no include left means all."""
    dotted = lambda xs: list(dict.fromkeys((x if x.startswith(".") else "." + x).lower() for x in xs))
    drop = dotted(exclude)
    take = [x for x in dotted(include) if x not in drop]
    ends = lambda xs: reduce(lambda a, b: a | b, (F.lower(path).endswith(x) for x in xs))
    test = ends(take) if take else F.lit(True)
    return test & ~ends(drop) if drop else test


def factual_boost(text: Column, query: Column) -> Column:
    """0.05 for each number of the query in the text and again for each of four digits, 0.03 for each phrase, 0.2 at most."""
    low = F.lower(text)
    share = lambda found, each: F.size(F.filter(found, lambda x: F.contains(low, F.lower(x)))) * each
    return F.least(share(F.regexp_extract_all(query, F.lit(r"\b\d+\b"), F.lit(0)), 0.05) + share(F.regexp_extract_all(query, F.lit(r"\b\d{4}\b"), F.lit(0)), 0.05) + share(phrases(query), 0.03), F.lit(0.2))
