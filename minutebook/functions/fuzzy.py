"""Trigram and edit-distance similarity, and spelling correction from the collection's own words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words of a text, each word padded by two spaces before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda w: w != "")

    def of(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 where neither has any."""
    x, y = trigrams(a), trigrams(b)
    either = F.size(F.array_union(x, y))
    return F.when(either > 0, F.size(F.array_intersect(x, y)) / either).otherwise(0.0)


def _ordered(text: str) -> list[str]:
    import re

    return [f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", text.lower()) for i in range(len(w) + 1)]


def best_extent(query: str, text: str | None) -> float:
    """Greatest similarity of the query's trigrams to those of a contiguous stretch of the text."""
    q = set(_ordered(query))
    if not q or not text:
        return 0.0
    t = _ordered(text)
    best = 0.0
    hits = [i for i, g in enumerate(t) if g in q]
    for k, lo in enumerate(hits):
        seen: set[str] = set()
        own: set[str] = set()
        at = lo
        for hi in hits[k:]:
            seen.update(t[at : hi + 1])
            at = hi + 1
            own.add(t[hi])
            best = max(best, len(own) / (len(q) + len(seen) - len(own)))
            if hi - lo > 3 * len(q):
                break
    return best


def word_similarity(query: str):
    """Arrow function of a text: best_extent of a fixed query."""

    @F.pandas_udf(T.DoubleType())
    def score(s: pd.Series) -> pd.Series:
        return s.map(lambda x: best_extent(query, x))

    return score


def osa(a: str, b: str) -> int:
    """Edit distance with exchanges of neighbours, each stretch edited once."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b)], dtype="Int32")


def vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """(word, n): words of 4 to 24 letters of the texts."""
    words = texts.select(F.explode(F.split(F.lower(F.col(text)), "[^a-z]+")).alias("word"))
    return words.where(F.length("word").between(4, 24)).groupBy("word").agg(F.count("*").alias("n"))


def corrections(queries: DataFrame, vocab: DataFrame, word: str = "word") -> DataFrame:
    """(word, correction, distance) of each query word: the nearest word of the vocabulary that begins alike, at most
    one edit away, the least of equal ones. Joins on the first letter and the length, so no pair is made that can't
    match by these; words of the vocabulary itself stand at distance 0. Words without a correction are left out."""
    q = queries.select(F.col(word).alias("q")).distinct().where(F.length("q") >= 2)
    q = q.withColumn("first", F.substring("q", 1, 1)).withColumn("size", F.explode(F.array(F.length("q") - 1, F.length("q"), F.length("q") + 1)))
    v = vocab.select(F.col("word").alias("v"), F.substring("word", 1, 1).alias("first"), F.length("word").alias("size"))
    near = q.join(v, ["first", "size"]).where(F.levenshtein("q", "v", 2) >= 0)
    near = near.withColumn("d", osa_distance("q", "v")).where(F.col("d") <= 1)
    best = near.groupBy("q").agg(F.min(F.struct("d", "v")).alias("b"))
    return best.select(F.col("q").alias("word"), F.col("b.v").alias("correction"), F.col("b.d").alias("distance"))
