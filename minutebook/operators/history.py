"""Type-two history of changing attributes, from periodic snapshots (problem 3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minutebook.session import cut

OPEN = "open"


def district_key(c: Column) -> Column:
    """One spelling for each district: ' 4 ', '04', 'District 4' -> '4'; 'AT LARGE', ' At-Large' -> 'at large'."""
    s = F.trim(F.regexp_replace(F.lower(c), r"[\s_-]+", " "))
    s = F.trim(F.regexp_replace(s, r"^(district|dist\.?)\s*", ""))
    return F.when(s.rlike(r"^\d+$"), F.regexp_replace(s, r"^0+(?=\d)", "")).otherwise(s)


def date_key(c: Column) -> Column:
    """A calendar date written as yyyy-MM-dd, with a time after it, as MM/dd/yyyy or as 'January 8, 1996'. Anything
    else stays as trimmed text, so that an unreadable value still compares by its text."""
    s = F.trim(c)
    read = F.coalesce(
        F.try_to_timestamp(F.regexp_extract(s, r"^(\d{4}-\d{1,2}-\d{1,2})", 1), F.lit("yyyy-M-d")),
        F.try_to_timestamp(s, F.lit("M/d/yyyy")),
        F.try_to_timestamp(s, F.lit("MMMM d, yyyy")),
        F.try_to_timestamp(s, F.lit("MMM d, yyyy")),
    )
    return F.coalesce(F.date_format(read, "yyyy-MM-dd"), s)


def attribute_hash(columns: Sequence[Column]) -> Column:
    """Null and empty hash differently, and neighbouring values can't run into each other."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns])), 256)


def settled(df: DataFrame, keys: Sequence[str], at: str, attributes: dict[str, Column], delivered: str) -> DataFrame:
    """(keys, at, delivered, attributes, attribute_hash): of the rows with the same keys and date the last delivered
    one. Rows delivered at the same instant are settled by their values, so the result doesn't depend on file order.
    Rows without a date are left out. One aggregate with a map-side half."""
    slim = df.where(F.col(at).isNotNull()).select(*keys, at, delivered, *[c.alias(f"_a_{n}") for n, c in attributes.items()])
    best = slim.groupBy(*keys, at).agg(F.max(F.struct(delivered, *[f"_a_{n}" for n in attributes])).alias("_best"))
    out = best.select(*keys, at, F.col("_best")[delivered].alias(delivered), *[F.col("_best")[f"_a_{n}"].alias(n) for n in attributes])
    return out.withColumn("attribute_hash", attribute_hash([F.col(n) for n in attributes]))


def runs(rows: DataFrame, keys: Sequence[str], at: str, names: Sequence[str]) -> DataFrame:
    """(keys, names, attribute_hash, valid_from, valid_to, seen_to) of settled rows: one row per longest run of dates
    with the same hash. valid_to is null while open, seen_to the last date of the key.

    A key with very many dates doesn't meet in one task: runs are first collapsed within each key and year, and only
    the first row of each of these goes to the second step."""
    rows = rows.withColumn("_year", F.year(at))
    within = Window.partitionBy(*keys, "_year").orderBy(at)
    rows = rows.withColumn("_before", F.lag("attribute_hash").over(within)).withColumn("_seen", F.max(at).over(Window.partitionBy(*keys, "_year")))
    starts = rows.where(~F.col("attribute_hash").eqNullSafe(F.col("_before")))
    whole, across = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(at)
    starts = starts.withColumn("_seen", F.max("_seen").over(whole)).withColumn("_before", F.lag("attribute_hash").over(across))
    starts = starts.where(~F.col("attribute_hash").eqNullSafe(F.col("_before")))
    return starts.select(*keys, *names, "attribute_hash", F.col(at).alias("valid_from"), F.lead(at).over(across).alias("valid_to"), F.col("_seen").alias("seen_to"))


def versions(df: DataFrame, keys: Sequence[str], at: str, attributes: dict[str, Column], delivered: str) -> DataFrame:
    """Full history in one step; see runs(). Null keys form a key of their own, a missing snapshot ends nothing, a value
    that returns starts a new version. An empty table gives an empty result; other columns of df play no part."""
    return runs(settled(df, keys, at, attributes, delivered), list(keys), at, list(attributes))


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """left joined with the keys of right, nulls equal."""
    other = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], how)


def merge(current: DataFrame, known: DataFrame, incoming: DataFrame, keys: Sequence[str], at: str, names: Sequence[str], delivered: str) -> tuple[DataFrame, DataFrame]:
    """Type-two merge of settled() snapshots into a history made by runs(): (history, snapshots known now).

    A key whose new snapshots are all later than what was seen of it has their attribute hashes compared with its open
    version, which closes at the date of the first that differs; each change inserts a version. A key with a late or
    corrected snapshot, one dated within what was seen, is opened again: all its versions are made anew from the known
    snapshots. Keys without news pass through. current, known and incoming may be empty; all have the columns that
    runs() and settled() give."""
    keys, names = list(keys), list(names)
    opened = current.where(F.col("valid_to").isNull())
    seen = opened.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("seen_to").alias("_seen"))
    late = incoming.select(*keys, at).join(seen, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).where(F.col(at) <= F.col("_seen")).select(*keys).distinct()

    both = known.unionByName(incoming).groupBy(*keys, at).agg(F.max(F.struct(delivered, *names, "attribute_hash")).alias("_best"))
    both = both.select(*keys, at, *[F.col("_best")[c].alias(c) for c in (delivered, *names, "attribute_hash")])
    again = runs(_beside(both, late, keys, "left_semi"), keys, at, names)

    calm = _beside(current, late, keys, "left_anti")
    news = runs(_beside(incoming, late, keys, "left_anti"), keys, at, names)
    chain = calm.where(F.col("valid_to").isNull()).drop("valid_to").unionByName(news.drop("valid_to"))
    across, whole = Window.partitionBy(*keys).orderBy("valid_from"), Window.partitionBy(*keys)
    chain = chain.withColumn("_before", F.lag("attribute_hash").over(across)).withColumn("seen_to", F.max("seen_to").over(whole))
    chain = chain.where(~F.col("attribute_hash").eqNullSafe(F.col("_before"))).withColumn("valid_to", F.lead("valid_from").over(across))
    out = calm.where(F.col("valid_to").isNotNull()).unionByName(chain.select(*current.columns)).unionByName(again.select(*current.columns))
    return out, both.select(*known.columns)


def folded(df: DataFrame, keys: Sequence[str], at: str, attributes: dict[str, Column], delivered: str, steps: int = 3) -> DataFrame:
    """The history of all deliveries, merged in `steps` equal stretches of delivery time, as they would arrive; the
    first stretch is merged into nothing. Deliveries without a time come first. What a step leaves is written to the
    shared folder, so each merge starts from tables."""
    names = list(attributes)
    rows = cut(df.select(*keys, at, F.col(delivered).alias("_t"), *[c.alias(n) for n, c in attributes.items()]).withColumnRenamed("_t", delivered))
    ends = rows.select(F.min(delivered).cast("double").alias("a"), F.max(delivered).cast("double").alias("b")).first()
    step = F.lit(0) if ends.a is None or ends.b == ends.a else F.coalesce(F.least(F.floor((F.col(delivered).cast("double") - ends.a) / (ends.b - ends.a) * steps), F.lit(steps - 1)), F.lit(0))
    rows = rows.withColumn("_step", step)
    same = {n: F.col(n) for n in names}
    known = settled(rows.limit(0), keys, at, same, delivered)
    history = runs(known, list(keys), at, names)
    for k in range(steps):
        history, known = merge(history, known, settled(rows.where(F.col("_step") == k), keys, at, same, delivered), keys, at, names, delivered)
        history, known = cut(history), cut(known) if k < steps - 1 else known
    return history


SUPERVISOR_KEYS = ("feed", "supervisor_id")


def supervisor_versions(snapshots: DataFrame, steps: int = 3) -> DataFrame:
    """The history of district, active and term_start of each member in each feed, by folded()."""
    attributes = {"district": district_key(F.col("district")), "active": F.col("active"), "term_start": date_key(F.col("term_start"))}
    return folded(snapshots, SUPERVISOR_KEYS, "snapshot_date", attributes, "captured_at", steps)
