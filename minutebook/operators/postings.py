"""An inverted index: postings of terms, written once, from which a query reads only the terms it names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutebook.functions import fulltext
from minutebook.session import cut


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stop = set(fulltext.STOP_WORDS)
    for batch in batches:
        rows = [(w, fulltext.stem(w)) for w in batch.column(0).to_pylist() if w not in stop]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string())], ["word", "term"])


def postings(rows: DataFrame, key: str, fields: dict[str, float], stems: bool = False) -> DataFrame:
    """(term, key, weight, positions): where each term stands in the fields of each row, from 0, with the field's
    weight. Positions run on from field to field with a gap, so no phrase reaches over. Rows of equal keys count once.
    With stems, each distinct word is stemmed once and stop words have no postings."""
    parts = []
    for k, (name, weight) in enumerate(fields.items()):
        words = F.split(F.trim(fulltext.analyse(F.col(name))), " ")
        parts.append(rows.where(F.col(name).isNotNull()).select(F.col(key).alias("key"), F.lit(float(weight)).alias("weight"), F.posexplode(words).alias("at", "word"), F.lit(k << 32).alias("base")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.where("word <> ''").select("word", "key", "weight", (F.col("base") + F.col("at")).alias("at"))
    grouped = every.groupBy("word", "key", "weight").agg(F.sort_array(F.collect_set("at")).alias("positions"))
    if not stems:
        return grouped.withColumnRenamed("word", "term").select("term", "key", "weight", "positions")
    grouped = cut(grouped)
    terms = grouped.select("word").distinct().mapInArrow(_stems, "word string, term string")
    return grouped.join(terms, "word").groupBy("term", "key", "weight").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def write(index: DataFrame, path: str, parts: int | None = None) -> None:
    """The index as a table sorted by term within ranges of terms, so that a query's filter skips all other row groups."""
    spread = index.repartitionByRange(parts, "term") if parts else index.repartitionByRange("term")
    spread.sortWithinPartitions("term", "key").write.mode("overwrite").parquet(path)


def _phrase(places: Column, words: tuple[str, ...]) -> Column:
    """Whether the words stand one after another; places maps terms to positions."""
    at = [F.coalesce(F.try_element_at(places, F.lit(w)), F.array().cast("array<bigint>")) for w in words]
    if len(at) == 1:
        return F.size(at[0]) > 0
    return F.exists(at[0], lambda p: _all([F.array_contains(x, p + k) for k, x in enumerate(at) if k]))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def search(index: DataFrame, *queries: str, stems: bool = False) -> DataFrame:
    """(key, score) of the rows that match a web-style query or one of its other ways to put it; score is the damped
    weighted sum of the logs of the terms' frequencies. One filter by term and one exchange by key. A query of excluded
    terms alone matches nothing, as an index holds no rows without terms."""
    alternatives = [[t for t in a] for q in queries for a in fulltext.parse(q, stems)]
    alternatives = [a for a in alternatives if any(not t.negated for t in a)]
    words = sorted({w for a in alternatives for t in a for w in t.words})
    if not words:
        return index.where("false").select("key", F.lit(0.0).alias("score"))
    some = index.where(F.col("term").isin(*words))
    wanted = fulltext.wanted(*queries, stems=stems)
    weigh = F.sum(F.when(F.col("term").isin(*wanted), F.log1p(F.size("positions").cast("double")) * F.col("weight")).otherwise(0.0))
    rows = some.groupBy("key", "term").agg(F.flatten(F.collect_list("positions")).alias("positions"), weigh.alias("r"))
    rows = rows.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("places"), F.sum("r").alias("r"))
    fits = None
    for a in alternatives:
        one = _all([~_phrase(F.col("places"), t.words) if t.negated else _phrase(F.col("places"), t.words) for t in a])
        fits = one if fits is None else fits | one
    return rows.where(fits).select("key", (F.col("r") / (F.col("r") + 1)).alias("score"))
