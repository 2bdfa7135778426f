"""Retrieval measures. run: (query_id, doc_id, rank from 0); qrels: (query_id, doc_id, rel)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def measures(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row for each query of qrels: ndcg, mrr, recall, precision, ap, each at k."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    gain = F.col("rel") / F.log2(F.col("rank") + 2)
    ideal = qrels.filter("rel > 0").withColumn("rank", F.row_number().over(w) - 1)
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("n_rel"), F.sum(F.when(F.col("rank") < k, gain).otherwise(0.0)).alias("idcg"))
    hits = run.filter(F.col("rank") < k).join(qrels.filter("rel > 0"), ["query_id", "doc_id"])
    order = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("i", F.row_number().over(order))
    got = hits.groupBy("query_id").agg(F.sum(gain).alias("dcg"), F.min("rank").alias("first"), F.count("*").alias("found"), F.sum(F.col("i") / (F.col("rank") + 1)).alias("ap"))
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return ideal.join(got, "query_id", "left").select(
        "query_id", z(F.col("dcg") / F.col("idcg")).alias("ndcg"), z(1 / (F.col("first") + 1)).alias("mrr"), z(F.col("found") / F.col("n_rel")).alias("recall"), z(F.col("found") / F.lit(k)).alias("precision"), z(F.col("ap") / F.col("n_rel")).alias("map")
    )


def mean(per_query: DataFrame, measure: str, by: str | None = None) -> DataFrame:
    value = F.round(F.avg(measure), 6).alias(measure)
    return per_query.groupBy(by).agg(value) if by else per_query.agg(value)


def paired_t(a: DataFrame, b: DataFrame, measure: str) -> DataFrame:
    """Student's paired test of two runs: (n, difference, t, p), p two-sided. Without spread p is 1 for equal
    runs and 0 for others; with fewer than two queries t and p are null."""
    d = a.select("query_id", F.col(measure).alias("x")).join(b.select("query_id", F.col(measure).alias("y")), "query_id").withColumn("d", F.col("x") - F.col("y"))
    s = d.agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("sd"))
    t = F.try_divide(F.col("m"), F.col("sd") / F.sqrt("n"))
    p = F.when(F.col("n") < 2, None).when(F.col("sd") == 0, F.when(F.col("m") == 0, 1.0).otherwise(0.0)).otherwise(two_sided_p(t, F.col("n") - 1))
    return s.select("n", F.round("m", 6).alias("difference"), F.round(t, 6).alias("t"), F.round(p, 6).alias("p"))


def two_sided_p(t: Column, df: Column) -> Column:
    """Chance of a |Student's t| as great, by the finite sums for whole degrees of freedom."""
    a = F.atan(F.abs(t) / F.sqrt(df))
    c2 = F.cos(a) * F.cos(a)
    odd = df % 2 == 1
    # terms k = 1, 2, ...: odd: 2 4 .. / 3 5 ..; even: 1 3 .. / 2 4 ..
    steps = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")
    shift = F.when(odd, 1.0).otherwise(0.0)
    series = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, k: F.struct((s["term"] * c2 * (2 * k - 1 + shift) / (2 * k + shift)).alias("term"), (s["sum"] + s["term"] * c2 * (2 * k - 1 + shift) / (2 * k + shift)).alias("sum")),
        lambda s: s["sum"],
    )
    inside = F.when(odd, 2 / F.pi() * (a + F.when(df > 1, F.sin(a) * F.cos(a) * series).otherwise(0.0))).otherwise(F.sin(a) * series)
    return F.greatest(1 - inside, F.lit(0.0))


def significant(p: Column, most: float = 0.05) -> Column:
    return p <= most


def report(runs: dict[str, DataFrame], qrels: DataFrame, k: int = 10) -> DataFrame:
    """(mode, queries, ndcg, mrr, recall, precision, map): means of each run, best ndcg first."""
    rows = [measures(run, qrels, k).agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "mrr", "recall", "precision", "map"))).select(F.lit(mode).alias("mode"), "*") for mode, run in runs.items()]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("ndcg"), "mode")


def compared(runs: dict[str, DataFrame], qrels: DataFrame, measure: str = "ndcg", k: int = 10, most_p: float = 0.05) -> DataFrame:
    """(a, b, n, difference, t, p, significant) of each two runs."""
    per = {mode: measures(run, qrels, k) for mode, run in runs.items()}
    names = list(per)
    rows = [paired_t(per[a], per[b], measure).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "*", significant(F.col("p"), most_p).alias("significant")) for i, a in enumerate(names) for b in names[i + 1 :]]
    return reduce(DataFrame.unionByName, rows)


def against_published(results: DataFrame, published: DataFrame) -> DataFrame:
    """(system, dataset, ndcg, own): own results (dataset, mode, ndcg) among published ones (system, dataset, ndcg),
    best first in each dataset."""
    own = results.select(F.col("mode").alias("system"), "dataset", "ndcg", F.lit(True).alias("own"))
    return own.unionByName(published.select("system", "dataset", "ndcg", F.lit(False).alias("own"))).orderBy("dataset", F.desc("ndcg"), "system")
