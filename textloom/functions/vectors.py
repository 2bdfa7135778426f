"""Vector functions over arrays of doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rounded(x: Column, places: int) -> Column:
    """To so many places; as in SQL engines, what rounds to zero keeps its sign, which F.round drops."""
    return F.rint(x * 10.0**places) / 10.0**places


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v)) + 1e-9
    return F.transform(v, lambda x: x.cast("double") / norm)


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors; 0 if one is missing."""
    return F.coalesce(dot(a, b), F.lit(0.0))


def _packed(rows: DataFrame, key: str, v: str, size: int) -> DataFrame:
    """(block, ids, vs): rows dealt by hash into blocks of about `size`."""
    d = rows.filter(F.col(v).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v"))
    n = max(1, -(-d.count() // size))
    packed = d.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("r"))
    return packed.select("block", F.col("r.id").alias("ids"), F.col("r.v").alias("vs"))


def best_products(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, doc_id, score): for each query (query_id, qv) at least its k best vectors (doc_id, v) by inner
    product, rounded to six places, itself left out. A task meets one block of queries with one of vectors and
    returns k rows of a query (more where the k-th score is tied), never all pairs."""
    d, q = _packed(vectors, "doc_id", "v", block), _packed(queries, "query_id", "qv", block)
    blocks = d.select(F.max("block")).first()[0]
    if blocks is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    met = q.select(F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"), F.explode(F.sequence(F.lit(0), F.lit(blocks))).alias("block")).join(d, "block")
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            for q_ids, q_vs, ids, vs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                q_ids, ids = np.array(q_ids), np.array(ids)
                s = np.round(np.array(q_vs) @ np.array(vs).T, 6)
                s[q_ids[:, None] == ids[None, :]] = -np.inf
                limit = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                i, j = np.nonzero((s >= limit[:, None]) & (s > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(s[i, j])], schema=schema)

    return met.select("q_ids", "q_vs", "ids", "vs").mapInArrow(run, "query_id long, doc_id long, score double")
