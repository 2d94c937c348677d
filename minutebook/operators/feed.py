"""Change feed, keyset pages, snapshots and job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minutebook.session import cut


def page(rows: DataFrame, key: str, cursor: int = 0, limit: int = 1000, *where: Column) -> DataFrame:
    """The next rows after a cursor, by key: a filter that reaches the scan and a top-k, no offset."""
    for w in (F.col(key) > cursor, *where):
        rows = rows.where(w)
    return rows.orderBy(key).limit(limit)


def next_cursor(rows: DataFrame, key: str, limit: int) -> int | None:
    """The cursor after a page; None if the page isn't full."""
    r = rows.agg(F.count("*").alias("n"), F.max(key).alias("top")).first()
    return r.top if r.n == limit else None


def numbered(rows: DataFrame, order: list[str], after: int = 0) -> DataFrame:
    """rows with consecutive seq numbers from after + 1 on, in `order`. Rows are range-partitioned and counted a
    partition, so no task sorts them all; the partitioned rows are written once, so the counts hold for what is read."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    spread = cut(spread)
    counts = spread.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("_first"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a row a partition
    return spread.join(F.broadcast(counts.select("_p", "_first", "before")), "_p").withColumn("seq", F.col("before") + F.col("_i") - F.col("_first") + 1 + after).drop("_p", "_i", "_first", "before")


def changes(before: DataFrame, after: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """(entity_type, entity_key, change_type, version): create, update and delete between two states, by a hash of all
    other columns."""
    others = [c for c in after.columns if c not in keys]
    h = lambda df, name: df.select(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("entity_key"), F.sha2(F.to_json(F.struct(*others)), 256).alias(name))
    both = h(before, "x").join(h(after, "y"), "entity_key", "full").where(~F.col("x").eqNullSafe(F.col("y")))
    kind = F.when(F.col("x").isNull(), "create").when(F.col("y").isNull(), "delete").otherwise("update")
    return both.select(F.lit(entity).alias("entity_type"), "entity_key", kind.alias("change_type"), F.coalesce("y", "x").alias("version"))


def document_snapshot(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents with their latest version, in the names of the public feed."""
    last = versions.groupBy("document_id").agg(F.max_by("content_sha256", "version_number").alias("contentSha256"), F.max("version_number").alias("version"))
    d = documents.join(last, documents["id"] == last["document_id"], "left")
    return d.select(F.col("id").cast("string").alias("id"), F.col("meeting_date").cast("string").alias("meetingDate"), "kind", "title", F.col("official_url").alias("officialUrl"), F.col("page_count").alias("pageCount"), "version", "contentSha256")


def item_snapshot(items: DataFrame, roll_calls: DataFrame) -> DataFrame:
    """Items with their roll calls as an ordered array, empty where there is none."""
    calls = roll_calls.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("sequence", "action", "ayes", "noes", "absent", "excused"))).alias("rollCalls"))
    i = items.join(calls, items["id"] == calls["item_id"], "left")
    none = F.array().cast(calls.schema["rollCalls"].dataType)
    return i.select(F.col("id").cast("string").alias("id"), F.col("document_id").cast("string").alias("documentId"), F.col("file_number").alias("fileNumber"), "title", F.coalesce("rollCalls", none).alias("rollCalls"))


def probe_states(jobs: DataFrame, probes: DataFrame) -> DataFrame:
    """Jobs after a round of probes, both (source_key, content_length, etag) and jobs with status: a new source waits,
    a failed one waits again, a complete one waits again if a value that both know has changed, others stay."""
    a, b = jobs.alias("a"), probes.alias("b")
    both = a.join(b, F.col("a.source_key") == F.col("b.source_key"), "full")
    differs = F.coalesce(F.col("a.etag") != F.col("b.etag"), F.lit(False)) | F.coalesce(F.col("a.content_length") != F.col("b.content_length"), F.lit(False))
    state = F.when(F.col("a.source_key").isNull(), "pending").when(F.col("b.source_key").isNull(), F.col("a.status")).when(F.col("a.status") == "failed", "pending").when((F.col("a.status") == "complete") & differs, "pending").otherwise(F.col("a.status"))
    return both.select(F.coalesce("a.source_key", "b.source_key").alias("source_key"), state.alias("status"), F.coalesce("b.content_length", "a.content_length").alias("content_length"), F.coalesce("b.etag", "a.etag").alias("etag"))
