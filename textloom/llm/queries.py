"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import brown_lm, fm_index, kdtree, line_blocks, packing, parity_join, repair, secrets, token_count, toxicity
from .common import table
from .sql import ORACLES


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; executors find it at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.scores(table(spark, sf_dir, "documents"))


def op2_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extract_pages(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.search_all(table(spark, sf_dir, "embeddings"))


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.digest(fm_index.find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents"))


def op9_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.similar_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_brown_lm, op2_line_blocks, op3_toxicity, op4_kdtree_topk, op5_token_count, op6_decontaminate, op7_repair_ids, op8_secret_scan, op9_parity_join, op10_packing, pipeline)}
ORACLE_SQL: dict[str, str] = ORACLES
