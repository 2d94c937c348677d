"""Vector similarity, hybrid scores and rank fusion."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where the lengths differ, a norm is 0 or one is null."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, p: s + p * p))
    return F.when(F.size(x) != F.size(y), 0.0).otherwise(F.coalesce(dot / F.nullif(norm(x) * norm(y), F.lit(0.0)), F.lit(0.0)))


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """(key, score): the k rows nearest to a query vector, exactly, ties by key. One scan and a top-k; the query is a
    literal of the plan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.col(vector).isNotNull()).select(key, cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def hybrid(rows: DataFrame, lexical: str = "lexical", semantic: str = "cosine") -> DataFrame:
    """rows with score = 0.65 lexical / greatest lexical + 0.35 (cosine + 1) / 2; a row without a vector gets no
    semantic part. The greatest lexical score is one row that joins back."""
    top = rows.agg(F.greatest(F.max(lexical), F.lit(1e-6)).alias("_top"))
    part = F.coalesce((F.col(semantic) + 1) / 2, F.lit(0.0))
    return rows.crossJoin(F.broadcast(top)).withColumn("score", 0.65 * F.col(lexical) / F.col("_top") + 0.35 * part).drop("_top")


def fuse(lexical: DataFrame, semantic: DataFrame, boosted: Column, k: int) -> DataFrame:
    """Reciprocal rank fusion of bounded candidate lists: lexical (key, list_no, score), whose rank runs through the
    concatenated lists; semantic (key, cosine). A row of `boosted` gains 0.008, a semantic rank counts 0.8."""
    lex = lexical.withColumn("r", F.row_number().over(Window.orderBy("list_no", F.desc("score"), "key"))).withColumn("f", 1 / (60 + F.col("r")) + F.when(boosted, 0.008).otherwise(0.0))
    sem = semantic.withColumn("s", F.row_number().over(Window.orderBy(F.desc("cosine"), "key"))).select("key", "cosine", (0.8 / (60 + F.col("s"))).alias("g"))
    both = lex.select("key", "list_no", "score", "f").join(sem, "key", "full")
    total = F.coalesce("f", F.lit(0.008)) + F.coalesce("g", F.lit(0.0))
    return both.select("key", "list_no", "cosine", total.alias("fusion")).orderBy(F.desc("fusion"), "key").limit(k)


def hash_embedder(dimensions: int = 64):
    """Arrow function of a text: a deterministic bag-of-words vector of unit length, in place of a provider."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[float] | None:
            if x is None:
                return None
            v = np.zeros(dimensions)
            for w in x.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dimensions] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return s.map(one)

    return embed
