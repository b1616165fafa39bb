"""Exact cosine search over embedded chunks, and a deterministic offline embedder."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.constants import TOP_K_CHUNKS
from lattica.functions.text import cosine


class Embedder(Protocol):
    """Turns texts into vectors of one length; must be picklable."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashing of words into a fixed number of dimensions, unit length; needs no network."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def embed(df: DataFrame, text: str, embedder: Embedder | None = None, out: str = "embedding") -> DataFrame:
    """`df` plus a vector column, computed in Arrow batches."""
    run = embedder or HashingEmbedder()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(s: pd.Series) -> pd.Series:
        return pd.Series(list(run(s.fillna("").tolist())))

    return df.withColumn(out, vectors(text))


def embed_distinct(df: DataFrame, text: str, embedder: Embedder | None = None, out: str = "embedding") -> DataFrame:
    """`df` plus a vector column; each distinct text is embedded once and joined back, by its hash."""
    h = F.xxhash64(text)
    made = embed(df.where(F.col(text).isNotNull()).groupBy(h.alias("_h"), text).agg(F.lit(1).alias("_one")).drop("_one"), text, embedder, out)
    return df.withColumn("_h", h).join(made, ["_h", text], "left").drop("_h")


def scored(vectors: DataFrame, query: Column, vector: str = "embedding") -> DataFrame:
    return vectors.withColumn("distance", F.lit(1.0) - cosine(F.col(vector), query))


def top_k(vectors: DataFrame, query: Column, key: str, k: int = TOP_K_CHUNKS, where: Column | None = None, vector: str = "embedding") -> DataFrame:
    """The k nearest rows by cosine distance, ties by key; filters come before scoring and reach the scan.

    Each partition keeps k rows and only those travel (take-ordered), so nothing is sorted or shuffled whole.
    """
    return scored(vectors if where is None else vectors.where(where), query, vector).orderBy("distance", key).limit(k)


def nearest(queries: DataFrame, vectors: DataFrame, key: str, block: str, k: int) -> DataFrame:
    """(query, hit, distance, place): for many queries, the k nearest others of the same block.

    A stated query set against all rows, block by block. The pairs of a query are never gathered: the best k
    are kept by a window whose group limit runs before the shuffle.
    """
    from pyspark.sql import Window

    q = queries.select(F.col(key).alias("query"), F.col(block).alias("_b"), F.col("embedding").alias("_q"))
    v = vectors.select(F.col(key).alias("hit"), F.col(block).alias("_b"), F.col("embedding").alias("_v"))
    pairs = v.join(q, "_b").where("query <> hit").select("query", "hit", (F.lit(1.0) - cosine(F.col("_q"), F.col("_v"))).alias("distance"))
    ranked = pairs.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("distance", "hit")))
    return ranked.where(F.col("place") <= k)
