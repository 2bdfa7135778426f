"""Ranking: scores, fusion, features, near-duplicate and diversity folds. query_id is the key throughout.

After top_k a query's candidates are bounded (hundreds), so later windows and folds by query are over bounded
groups. Scores over a whole corpus are made where its rows are read (rows.py) or by blocks of a stored index
(blocks.py); bm25 and match_bm25 score the postings they are given, and top_k keeps k rows of a query in each task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.stem import folded_tokens, stem
from textloom.functions.text import NUMBER, grams, tokens
from textloom.operators import rows as in_rows


def bm25(queries: DataFrame, posted: DataFrame, vocab: DataFrame, stats: DataFrame, k1: float = 1.2, b: float = 0.75, key: str = "doc_id") -> DataFrame:
    """(query_id, key, score): every token of the query counts, repeated ones again."""
    terms = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    n, avgdl = F.col("n"), F.col("avgdl")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    known = terms.join(vocab.select("term", "df"), "term").crossJoin(F.broadcast(stats))  # one row
    return posted.join(known, "term").groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"))


def match_bm25(terms: DataFrame, posted: DataFrame, vocab: DataFrame, rows: DataFrame, k1: float = 1.2, b: float = 0.75, key: str = "doc_id") -> DataFrame:
    """(query_id, key, score) of the rows that hold any of a query's distinct terms, by the matcher's own
    negated score: row statistics (one row n, avgdl), and idf at least 1e-6. terms: (query_id, term, weight)."""
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = F.col("weight") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    known = terms.join(vocab.select("term", "df"), "term").crossJoin(F.broadcast(rows.select("n", "avgdl")))  # one row
    return posted.join(known, "term").groupBy("query_id", key).agg(F.round(-F.sum(part), 6).alias("score"))


def stem_match(queries: DataFrame, posted: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, hits): rows of postings (with stems) that hold any of a query's stemmed terms, and how
    many of its stems they hold."""
    asked = queries.select("query_id", F.explode(folded_tokens(F.col("text"))).alias("term")).withColumn("stem", stem(F.col("term"))).select("query_id", "stem").distinct()
    return posted.join(asked, "stem").groupBy("query_id", key).agg(F.countDistinct("stem").alias("hits"))


def stem_match_rows(queries: DataFrame, rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """stem_match over texts instead of stored postings: words are stemmed and looked up where a row is read."""
    asked = queries.select("query_id", F.explode(folded_tokens(F.col("text"))).alias("term")).withColumn("stem", stem(F.col("term"))).select("query_id", "stem").distinct().collect()
    return in_rows.stem_hits(rows, in_rows.Asked.of(((*r, 1) for r in asked), dict(queries.dtypes)["query_id"]), key, text)


def phrase_match(queries: DataFrame, rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, key, times): rows in whose tokens the query's tokens stand one after another, and how often. Two
    times don't share a border, so a phrase at once after itself is not counted again. Looked up where a row is read."""
    asked = queries.select("query_id", tokens(F.col("text")).alias("w")).collect()
    return in_rows.phrase_times(rows, [tuple(r) for r in asked], dict(queries.dtypes)["query_id"], key, text)


def top_k(scored: DataFrame, k: int, key: str = "doc_id", descending: bool = True) -> DataFrame:
    """The k best of each query, with `rank` from 0; ties by key. Each task keeps k rows of a query before
    the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score") if descending else F.asc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def minmax(score: Column) -> Column:
    """Scaled to 0..1 in the query; 0.5 where all are the same."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi - lo < 1e-9, 0.5).otherwise((score - lo) / (hi - lo))


def rrf(ranks: list[Column], count: Column, k: int = 60) -> Column:
    """Sum of reciprocal ranks from 0; a missing rank counts as the last."""
    return sum((1 / (k + F.coalesce(r, count)) for r in ranks[1:]), 1 / (k + F.coalesce(ranks[0], count)))


def spread(x: Column) -> Column:
    w = Window.partitionBy("query_id")
    return (x - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w) + 1e-9)


def boost_features(rows: DataFrame, query: str = "query", text: str = "text") -> DataFrame:
    """rows with jaccard, phrase, digit: overlap of tokens, share of the query's phrases, common numbers; each spread over the query's rows."""
    qt = F.filter(tokens(F.col(query)), lambda t: F.length(t) > 2)
    d = rows.withColumn("_q", qt).withColumn("_t", tokens(F.col(text))).withColumn("_s", F.array_join("_t", " "))
    q, t, s = F.col("_q"), F.col("_t"), F.col("_s")
    d = d.withColumn("_p", F.array_distinct(F.concat(grams(q, 2), grams(q, 3))))
    jac = F.size(F.array_intersect(q, t)) / F.greatest(F.size(F.array_union(q, t)), F.lit(1))
    phr = F.size(F.filter("_p", lambda p: F.contains(s, p))) / F.greatest(F.size("_p"), F.lit(1))
    nums = lambda x: F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0))
    dig = F.arrays_overlap(nums(F.array_join(q, " ")), nums(s)).cast("double")
    d = d.withColumn("_j", jac).withColumn("_f", phr).withColumn("_d", dig)
    return d.withColumn("jaccard", spread(F.col("_j"))).withColumn("phrase", spread(F.col("_f"))).withColumn("digit", spread(F.col("_d"))).drop("_q", "_t", "_s", "_p", "_j", "_f", "_d")


def boosted(fused: Column, jaccard: Column, phrase: Column, digit: Column) -> Column:
    return fused * (1 + 0.4 * jaccard + 0.3 * phrase + 0.1 * digit)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def dedup(ranked: DataFrame, threshold: float = 0.83, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each query's candidates (rank, text), best first, those less similar than the threshold to all
    kept before; with their new rank from 0."""
    row = F.struct("rank", F.col(key).alias("key"), F.array_distinct(tokens(F.col(text))).alias("t"))
    held = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("c"))
    empty = F.slice(F.col("c"), 1, 0)
    kept = F.aggregate("c", empty, lambda s, x: F.when(F.exists(s, lambda k: overlap(k["t"], x["t"]) >= threshold), s).otherwise(F.concat(s, F.array(x))))
    return held.select("query_id", F.posexplode(kept).alias("new_rank", "k")).select("query_id", F.col("k.key").alias(key), "k.rank", "new_rank")


def prf_gate(ranked: DataFrame, keys: DataFrame) -> DataFrame:
    """(query_id, expand): at most four content keys, or ten candidates of nearly equal scores. keys: (query_id, keys)."""
    s = ranked.filter("rank < 10").groupBy("query_id").agg(F.count("*").alias("n"), F.stddev_pop("score").alias("sd"))
    words = F.size(F.filter("keys", lambda k: ~k.rlike(NUMBER)))
    return keys.join(s, "query_id", "left").select("query_id", ((words <= 4) | F.coalesce((F.col("n") >= 10) & (F.col("sd") < 0.02), F.lit(False))).alias("expand"))


def prf_terms(top: DataFrame, queries: DataFrame, posted: DataFrame, docs: int = 10, most: int = 20, key: str = "doc_id") -> DataFrame:
    """(query_id, term, score, term_rank): expansion terms of the best documents, by weighted frequency."""
    weight = F.when(F.col("score") < 0, 1 / (1 + F.abs("score"))).otherwise(F.col("score"))
    best = top.filter(F.col("rank") < docs).select("query_id", key, weight.alias("w"))
    damp = F.when(F.col("tf") <= 2, 2.0).when(F.col("tf") <= 5, 1.5).otherwise(1.0)
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    found = best.join(posted, key).filter((F.length("term") >= 3) & ~F.col("term").rlike(r"^\d+$")).join(asked, ["query_id", "term"], "left_anti")
    scored = found.groupBy("query_id", "term").agg(F.round(F.sum(F.col("w") * F.col("tf") * damp), 6).alias("score")).filter("score > 0.1")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "term")
    return scored.withColumn("term_rank", F.row_number().over(w)).filter(F.col("term_rank") <= most).withColumn("term_rank", F.col("term_rank") - 1)


def anchored(keys: DataFrame, terms: DataFrame, rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, key): rows with any of the first three keys, or the first key and any of five expansion terms."""
    k = keys.select("query_id", F.posexplode("keys").alias("i", "term")).filter("i < 3").select("query_id", "term", F.when(F.col("i") == 0, 3).otherwise(1).alias("role"))
    e = terms.filter("term_rank < 5").select("query_id", "term", F.lit(4).alias("role"))
    asked = k.unionByName(e).groupBy("query_id", "term").agg(F.bit_or("role").alias("role")).collect()
    return in_rows.anchored(rows, in_rows.Asked.of((tuple(r) for r in asked), dict(keys.dtypes)["query_id"]), key, text)


def drift_guard(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, overlap, keep): share of ten first candidates that both lists hold; kept from 0.4."""
    a = before.filter("rank < 10").groupBy("query_id").agg(F.collect_list(key).alias("x"))
    b = after.filter("rank < 10").groupBy("query_id").agg(F.collect_list(key).alias("y"))
    share = F.size(F.array_intersect("x", "y")) / 10
    return a.join(b, "query_id").select("query_id", share.alias("overlap"), (share >= 0.4).alias("keep"))


def budget(scores: Column, default: int = 80) -> Column:
    """How many candidates to rerank, from a query's scores in falling order."""
    at = lambda i: F.get(scores, F.lit(i))
    ten = F.slice(scores, 1, 10)
    mean = F.aggregate(ten, F.lit(0.0), lambda s, x: s + x) / 10
    sd = F.sqrt(F.aggregate(ten, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / 10)
    return F.when(F.size(scores) < 10, F.least(F.size(scores), F.lit(default))).when((sd < 0.02) | (at(0) - at(9) < 0.1), 100).when(at(0) - at(4) > 0.4, 70).when(at(0) - at(9) > 0.5, 80).otherwise(90)


def rank_correlation(a: Column, b: Column) -> Column:
    """Spearman's, over the rows of a group; 0 for fewer than five."""
    n = F.count("*").cast("double")
    return F.when(n < 5, 0.0).otherwise(1 - 6 * F.sum((a - b) * (a - b)) / (n * (n * n - 1)))


def embedding_weight(spread_of_sims: Column) -> Column:
    return 0.6 + 0.4 / (1 + F.exp(-(spread_of_sims - 0.008) / 0.004))


def mmr(rows: DataFrame, lam: float = 0.7, most: int = 20, key: str = "doc_id") -> DataFrame:
    """(query_id, key, mmr_rank): rows (query_id, key, score, sim, v) reordered, best first, by similarity to
    the query less that to what is chosen. Rows without a vector are never chosen, but as the first."""

    def pick(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["score", key], ascending=[False, True]).reset_index(drop=True)
        have = [v is not None and len(v) > 0 for v in t["v"]]
        chosen, rest = [0], [i for i in range(1, len(t)) if have[i]]
        vec = {i: np.asarray(t["v"][i], dtype=float) for i in range(len(t)) if have[i]}
        near = {i: max(0.0, round(float(vec[i] @ vec[0]), 9)) if have[0] else 0.0 for i in rest}
        while rest and len(chosen) < most:
            best = max(rest, key=lambda i: (round(lam * t["sim"][i] - (1 - lam) * near[i], 9), -i))
            rest.remove(best)
            chosen.append(best)
            for i in rest:
                near[i] = max(near[i], round(float(vec[i] @ vec[best]), 9))
        return pd.DataFrame({"query_id": t["query_id"][chosen].to_numpy(), key: t[key][chosen].to_numpy(), "mmr_rank": range(len(chosen))})

    kind = dict(rows.dtypes)[key]
    return rows.select("query_id", key, "score", "sim", "v").groupBy("query_id").applyInPandas(pick, f"query_id long, {key} {kind}, mmr_rank int")
