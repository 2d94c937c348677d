"""Keyed merges without a table format: each takes the current and the incoming rows and gives the rows to keep.

Incoming rows with the same key settle by `order` first, so a merge has one row a key on each side and is one full
outer join on the key. Null keys match each other. Write the result with tables.publish().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by `order`; ties go to the greatest values, so file order plays no part."""
    others = [c for c in rows.columns if c not in keys]
    picked = [c for c in others if c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *picked)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in rows.columns])


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r")) if others else rows.distinct()
    return best.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in rows.columns])


def _joined(current: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, Column, Column]:
    a = current.withColumn("_is", F.lit(True)).alias("a")
    b = incoming.withColumn("_is", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, on, "full"), F.col("a._is").isNotNull(), F.col("b._is").isNotNull()


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], combine: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """current with incoming rows put in or over. combine gives, for a column, what becomes of an old and a new value
    where both rows exist, such as F.least, F.greatest or F.coalesce; other columns take the new value."""
    both, old, new = _joined(current, incoming, keys)
    out = []
    for c in current.columns:
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        value = F.coalesce(a, b) if c in keys else F.when(old & new, (combine or {}).get(c, lambda x, y: y)(a, b)).when(new, b).otherwise(a)
        out.append(value.alias(c))
    return both.select(*out)


def changed(current: DataFrame, incoming: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Incoming rows that are new or differ, null-safe, in one of the compared columns, with created: whether the key
    is new. Rows that change nothing are left out."""
    both, old, new = _joined(current, incoming, keys)
    differs = F.lit(False)
    for c in compare:
        differs = differs | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return both.where(new & (~old | differs)).select(*[F.col(f"b.{c}").alias(c) for c in incoming.columns], (~old).alias("created"))


def insert_new(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """current and those incoming rows whose key it lacks."""
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
    return current.unionByName(incoming.alias("b").join(current.select(*keys).alias("a"), on, "left_anti"))


def replace_children(current: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents that come in give way to the incoming ones."""
    return current.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def without_orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias("_p")).distinct(), F.col(child_key) == F.col("_p"), "left_semi")


def remap(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """rows with a key replaced through mapping (old, new); keys that it lacks stay."""
    m = mapping.groupBy("old").agg(F.min("new").alias("new"))
    return rows.join(m, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", F.col(column))).select(*rows.columns)


def merge_json(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects of strings: the new value of a key wins."""
    parse = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    a, b = parse(old), parse(new)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))
