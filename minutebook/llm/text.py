"""Small shared pieces of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(df: DataFrame, key: str) -> DataFrame:
    """One row of each key. Rows that arrive twice are exact copies, so any of them will do; the greatest is taken, so
    that the choice doesn't depend on file order. Null keys are left out."""
    others = [c for c in df.columns if c != key]
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*others)).alias("_r"))
    return out.select(key, *[F.col("_r")[c].alias(c) for c in others])


def ascii_words(c: Column) -> Column:
    """The words of a text in lower case: runs of a-z and 0-9, with one space between them."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
