"""Evaluation data: retrieval collections as JSON lines and tab-separated judgments, query files, made corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def collection(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, queries, qrels) of a folder with corpus.jsonl (_id, title, text), queries.jsonl (_id, text) and
    qrels/<split>.tsv (query-id, corpus-id, score). A document's text is its title, an empty line and its text."""
    c = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    title = F.trim(F.coalesce("title", F.lit("")))
    text = F.when(title != "", F.concat(title, F.lit("\n\n"), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    docs = c.select(F.col("_id").alias("doc_id"), F.concat(F.lit(folder.rstrip("/") + "/"), "_id", F.lit(".txt")).alias("path"), text.alias("text"))
    rel = spark.read.option("header", True).option("sep", "\t").csv(f"{folder}/qrels/{split}.tsv").toDF("query_id", "doc_id", "rel")
    rel = rel.withColumn("rel", F.col("rel").cast("int")).filter("rel > 0")
    q = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), "text")
    return docs, q.join(rel.select("query_id").distinct(), "query_id", "left_semi"), rel


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text): the lines of a file in their order, without comments, blanks and repeats."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "text"))
    return query_lines(rows.withColumn("text", F.trim("text")))


def query_lines(rows: DataFrame) -> DataFrame:
    """rows (at, text) -> (query_id, text): the first of equal lines, without comments and blanks."""
    kept = rows.filter((F.col("text") != "") & ~F.col("text").startswith("#"))
    return kept.groupBy("text").agg(F.min("at").cast("long").alias("query_id")).select("query_id", "text")


def made_corpus(spark: SparkSession, n: int, words: int = 200, seed: int = 42) -> DataFrame:
    """(path, size, mtime, text) of n made files over eight folders and five kinds, the same for the same seed."""
    terms = F.array(*map(F.lit, "server client token cache query index storage network deploy monitor signal vector ranking search document parser schema cluster session backup".split()))
    kinds, folders = F.array(*map(F.lit, (".txt", ".md", ".py", ".json", ".log.txt"))), F.array(*map(F.lit, "auth api db docs tests config build-tools ops".split()))
    pick = lambda xs, salt: F.get(xs, F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.size(xs)).cast("int"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.get(terms, F.pmod(F.xxhash64("id", i, F.lit(seed)), F.size(terms)).cast("int"))), " ")
    d = spark.range(n).select(F.concat(F.lit("/made/"), pick(folders, 1), F.lit("/f"), F.col("id").cast("string"), pick(kinds, 2)).alias("path"), F.col("id").cast("double").alias("mtime"), text.alias("text"))
    return d.select("path", F.length("text").cast("long").alias("size"), "mtime", "text")
