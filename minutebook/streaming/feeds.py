"""The change feed and the job states as streams, and event-time windows (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutebook.operators import tables


def events(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; zone-less times are read as UTC instants."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def once_only(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Replayed rows count once: duplicates by key within the lateness are dropped, so state stays bounded."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def tumbling(rows: DataFrame, at: str, size: str, *keys: str, late: str | None = None) -> DataFrame:
    """(window_start, keys, n, total) of each window; the same plan for a table and, with `late`, for a stream."""
    rows = rows.withWatermark(at, late) if late else rows
    return rows.groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(rows: DataFrame, at: str, gap: str, *keys: str, late: str | None = None) -> DataFrame:
    rows = rows.withWatermark(at, late) if late else rows
    return rows.groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), *keys, "n")


def upsert_into(path: str, keys: list[str], order: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the last row of each key goes into a table of operators.tables; running a batch again changes
    nothing, and only the buckets it touches are written. An error leaves the table as it was."""
    return lambda batch, _: tables.upsert(batch, path, keys, order, buckets)


def run_available(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there, then stop."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
