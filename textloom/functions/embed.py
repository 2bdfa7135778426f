"""Embedders: from texts to unit vectors, behind one interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import tokens
from .vectors import l2_normalize


class Embedder(Protocol):
    name: str
    dim: int
    version: str

    def embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """rows with `v`: a unit vector, or null where the text can't be embedded."""


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed counts of hashed tokens. Expressions only; needs no model, and gives equal vectors everywhere."""

    dim: int = 256
    name: str = "hashing"
    version: str = "1"

    def vector(self, text: Column) -> Column:
        at = F.transform(tokens(text), lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(self.dim)).cast("int").alias("i"), F.when(F.xxhash64(t, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
        cell = lambda i: F.aggregate(F.filter(at, lambda x: x["i"] == i), F.lit(0.0), lambda s, x: s + x["s"])
        made = l2_normalize(F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), cell))
        return F.when(F.size(at) > 0, made)

    def embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        return rows.withColumn("v", self.vector(F.col(text)))


@dataclass(frozen=True)
class TableEmbedder:
    """Vectors that are there already, by the text's hash: (text_hash, vector)."""

    vectors: DataFrame
    dim: int
    name: str = "table"
    version: str = "1"

    def embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        held = self.vectors.select(F.col("text_hash").alias("_hash"), l2_normalize(F.col("vector")).alias("v"))
        return rows.join(held, F.unhex(F.md5(text)) == F.col("_hash"), "left").drop("_hash")


@dataclass(frozen=True)
class ModelEmbedder:
    """A model that is loaded once in each Python worker: load() gives a function from texts to an array of
    rows. A batch that fails has null vectors, so a search falls back to words."""

    load: Callable[[], Callable[[list[str]], np.ndarray]]
    dim: int
    name: str
    version: str = "1"
    batch: int = 32

    def embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        load, batch = self.load, self.batch

        @F.pandas_udf("array<double>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = None
            for p in parts:
                out: list = []
                for i in range(0, len(p), batch):
                    some = [x or "" for x in p.iloc[i : i + batch]]
                    try:
                        model = model or load()
                        made = np.asarray(model(some), dtype=float)
                        made = made / (np.linalg.norm(made, axis=1, keepdims=True) + 1e-9)
                        out += list(made)
                    except Exception:  # a provider may be away: these rows have no vector
                        out += [None] * len(some)
                yield pd.Series(out, dtype=object)

        return rows.withColumn("v", run(F.col(text)))


def fill(index, embedder: Embedder, now: float):
    """Embed the chunks of a stored index that have no vector of this embedder yet, each text once."""
    have = index.vectors(embedder.name, embedder.dim, embedder.version).select("text_hash")
    new = index.chunks().select("text_hash", "text").dropDuplicates(["text_hash"]).join(have, "text_hash", "left_anti")
    v = embedder.embed(new).filter("v is not null")
    return index.put_vectors(v.select("text_hash", F.lit(embedder.name).alias("model"), F.lit(embedder.dim).alias("dim"), F.lit(embedder.version).alias("version"), F.col("v").alias("vector"), F.lit(now).alias("created")))
