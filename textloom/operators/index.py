"""The index as tables: postings, vocabulary, statistics, catalogue, vectors; and their maintenance.

Every change is a join that returns the new table: applying it twice gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import tokens


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, term, tf, dl): one row for each term of a chunk. Counted inside the row, as runs in its sorted
    tokens, so no token is shuffled."""
    t = tokens(F.col(text))
    d = chunks.select(F.col(key), F.size(t).cast("long").alias("dl"), F.array_join(F.sort_array(t), " ").alias("sorted"))
    runs = F.regexp_extract_all("sorted", F.lit(r"(?<![a-z0-9])([a-z0-9]++)(?: \1(?![a-z0-9]))*+"), F.lit(0))
    d = d.select(key, "dl", F.explode(runs).alias("run")).withColumn("term", F.substring_index("run", " ", 1))
    return d.select(key, "term", ((F.length("run") + 1) / (F.length("term") + 1)).cast("long").alias("tf"), "dl")


def row_stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row (n, avgdl): chunks that hold a token, and their mean tokens."""
    dl = chunks.select(F.size(tokens(F.col(text))).alias("dl")).filter("dl > 0")
    return dl.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def document_frequency(posted: DataFrame) -> DataFrame:
    """(term, df, cnt): rows that hold the term, and its occurrences."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cnt"))


def corpus_stats(chunks: DataFrame, file: str = "file_uid", text: str = "text") -> DataFrame:
    """One row (n, avgdl): files, and tokens for each file (at least one)."""
    t = chunks.select(file, F.size(tokens(F.col(text))).alias("k"))
    return t.agg(F.countDistinct(file).alias("n"), F.sum("k").alias("total")).select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the first row in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new take the place of old rows of the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def stale(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose keys new lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti")


def discover(listing: DataFrame, catalog: DataFrame, version: str) -> DataFrame:
    """Files of a listing that aren't in the catalogue as they are: path, size, mtime, version, active."""
    same = catalog.filter((F.col("version") == version) & (F.col("status") == "active")).select("path", "size", "mtime")
    return listing.join(same, ["path", "size", "mtime"], "left_anti")


def touch(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Where the content is the same, the catalogue takes the listing's path, size and mtime."""
    n = listing.select("file_uid", F.col("content_sig").alias("_sig"), F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    same = F.col("_sig").isNotNull() & (F.col("_sig") == F.col("content_sig"))
    j = catalog.join(n, "file_uid", "left")
    return j.select(*(F.when(same, F.col(new)).otherwise(F.col(c)).alias(c) if (new := {"path": "_p", "size": "_s", "mtime": "_m"}.get(c)) else F.col(c) for c in catalog.columns))


def mark_missing(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """The catalogue with status missing for paths that the listing lacks."""
    seen = listing.select("path", F.lit(True).alias("_seen")).distinct()
    return catalog.join(seen, "path", "left").withColumn("status", F.when(F.col("_seen"), F.col("status")).otherwise("missing")).select(catalog.columns)


def sweep_vectors(vectors: DataFrame, chunks: DataFrame, now: float, retention_days: float) -> DataFrame:
    """Vectors that a chunk refers to and that are younger than the retention."""
    return vectors.join(chunks.select("text_hash").distinct(), "text_hash", "left_semi").filter(F.col("created") >= now - retention_days * 86400)


def remove_files(catalog: DataFrame, chunks: DataFrame, vectors: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the files at these paths; a vector goes when no chunk left refers to it."""
    gone = catalog.join(paths, "path", "left_semi").select("file_uid")
    left = chunks.join(gone, "file_uid", "left_anti")
    lost = chunks.join(gone, "file_uid", "left_semi").select("text_hash").distinct().join(left.select("text_hash"), "text_hash", "left_anti")
    return catalog.join(gone, "file_uid", "left_anti"), left, vectors.join(lost, "text_hash", "left_anti")


def clear_vectors(vectors: DataFrame, now: float, older_than_days: float | None = None) -> DataFrame:
    return vectors.filter(F.lit(False)) if older_than_days is None else vectors.filter(F.col("created") >= now - older_than_days * 86400)


def status(catalog: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts."""
    a = catalog.agg(F.count_if(F.col("status") == "active").alias("files"), F.max("indexed_at").alias("last_indexed"))
    return a.crossJoin(chunks.agg(F.count("*").alias("chunks"))).crossJoin(vectors.agg(F.count("*").alias("vectors")))  # three single rows
