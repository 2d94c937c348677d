"""Ingestion jobs as keyed states: discovery, dispatch, finish; runs; and what is left to do.

A round of changes is one pass of joins over jobs and what is known of their sources; write the result with
tables.publish() or upsert it in foreachBatch. Times are given, so a round can be run again with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutebook.operators import merge

SOURCE = ("content_length", "etag", "last_modified")


def matched(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """(source_key, document_id): the indexed document of each job: of the same URL, else of the same event and kind,
    else, for jobs without an event, of the same date and kind; of several the one indexed last. Each condition is an
    equi-join of its own, and their preference a maximum, so no pairs are tried."""
    d = documents.where(F.col("page_count") > 0).select("id", "official_url", "event_id", "kind", "meeting_date", "indexed_at").dropDuplicates(["id"])
    j = jobs.select("source_key", "official_url", "event_id", "kind", "meeting_date")
    best = lambda rank: F.struct(F.lit(rank).alias("rank"), F.col("indexed_at"), F.col("id"))
    newest = lambda *keys: d.where(F.coalesce(*keys[:1]).isNotNull()).groupBy(*keys).agg(F.max(F.struct("indexed_at", "id")).alias("n")).select(*keys, "n.*")
    ways = (
        j.join(newest("official_url"), "official_url").select("source_key", best(3).alias("b")),
        j.where(F.col("event_id").isNotNull()).join(newest("event_id", "kind"), ["event_id", "kind"]).select("source_key", best(2).alias("b")),
        j.where(F.col("event_id").isNull()).join(newest("meeting_date", "kind"), ["meeting_date", "kind"]).select("source_key", best(1).alias("b")),
    )
    return ways[0].unionByName(ways[1]).unionByName(ways[2]).groupBy("source_key").agg(F.max("b").alias("b")).select("source_key", F.col("b.id").alias("document_id"))


def discovered(jobs: DataFrame, candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Jobs after a round of discovery. candidates: (source_key, official_url, event_id, kind, meeting_date,
    content_length, etag, last_modified); jobs have status, attempts and error beside these. A new source waits, or is
    complete if its document is indexed; a failed one waits again without its error; a complete one waits again if a
    value of its source that both know has changed; other jobs stay. Unknown values keep what is known."""
    fresh = candidates.join(matched(candidates, documents).withColumn("indexed", F.lit(True)), "source_key", "left").drop("document_id")
    a, b = jobs.alias("a"), fresh.alias("b")
    both = a.join(b, F.col("a.source_key") == F.col("b.source_key"), "full")
    differs = F.lit(False)
    for c in SOURCE:
        differs = differs | F.coalesce(F.col(f"a.{c}") != F.col(f"b.{c}"), F.lit(False))
    was, new, seen = F.col("a.status"), F.col("a.source_key").isNull(), F.col("b.source_key").isNotNull()
    status = F.when(new, F.when(F.col("b.indexed"), "complete").otherwise("pending")).when(seen & ((was == "failed") | (was == "complete") & differs), "pending").otherwise(was)
    out = {
        "source_key": F.coalesce("a.source_key", "b.source_key"), "official_url": F.coalesce("b.official_url", "a.official_url"), "kind": F.coalesce("a.kind", "b.kind"), "meeting_date": F.coalesce("a.meeting_date", "b.meeting_date"),
        **{c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) for c in ("event_id", *SOURCE)},
        "status": status, "attempts": F.coalesce(F.col("a.attempts"), F.lit(0)), "error": F.when(~(seen & (was == "failed")), F.col("a.error")),
    }
    return both.select(*[c.alias(name) for name, c in out.items()])


def _moved(jobs: DataFrame, keys: DataFrame, frm: tuple[str, ...], **to: Column) -> DataFrame:
    """Jobs of these keys and of a status in frm take other values."""
    named = jobs.join(keys.select("source_key", F.lit(True).alias("_named")).distinct(), "source_key", "left")
    here = F.coalesce("_named", F.lit(False)) & F.col("status").isin(*frm)
    return named.select(*[F.when(here, to[c]).otherwise(F.col(c)).alias(c) if c in to else F.col(c) for c in jobs.columns])


def dispatched(jobs: DataFrame, keys: DataFrame) -> DataFrame:
    return _moved(jobs, keys, ("pending",), status=F.lit("dispatched"))


def running(jobs: DataFrame, keys: DataFrame) -> DataFrame:
    """Jobs that a worker takes; each counts an attempt."""
    return _moved(jobs, keys, ("pending", "dispatched", "failed"), status=F.lit("running"), attempts=F.col("attempts") + 1, error=F.lit(None).cast("string"))


def finished(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Running jobs whose document is indexed are complete; the others still run."""
    return _moved(jobs, matched(jobs.where("status = 'running'"), documents), ("running",), status=F.lit("complete"), error=F.lit(None).cast("string"))


def failed(jobs: DataFrame, error: str = "the workflow did not complete") -> DataFrame:
    """All running jobs have failed; an error that is known stays."""
    return _moved(jobs, jobs, ("running",), status=F.lit("failed"), error=F.coalesce("error", F.lit(error)))


def run_started(runs: DataFrame, run_id: str, source: str, parser_version: str, at: str) -> DataFrame:
    """Runs with a new one; runs of the source that still seem to run were interrupted and have failed."""
    stale = (F.col("source") == source) & (F.col("status") == "running")
    rows = runs.withColumns({"error": F.when(stale, "interrupted").otherwise(F.col("error")), "finished_at": F.when(stale, F.lit(at).cast("timestamp")).otherwise(F.col("finished_at")), "status": F.when(stale, "failed").otherwise(F.col("status"))})
    new = runs.sparkSession.range(1).select(F.lit(run_id).alias("id"), F.lit(source).alias("source"), F.lit("running").alias("status"), F.lit(parser_version).alias("parser_version"), F.lit(at).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit("{}").alias("statistics"), F.lit(None).cast("string").alias("error"))
    return rows.unionByName(new)


def run_finished(runs: DataFrame, run_id: str, at: str, statistics: Column | None = None, error: str | None = None, longest: int = 10_000) -> DataFrame:
    """Runs with one finished: complete with its statistics as JSON, or failed with its error, cut to `longest`."""
    own = F.col("id") == run_id
    put = {"status": F.lit("complete" if error is None else "failed"), "finished_at": F.lit(at).cast("timestamp"), "error": F.lit(error and error[:longest]).cast("string")}
    if statistics is not None:
        put["statistics"] = F.to_json(statistics)
    return runs.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in put.items()})


def of_other_version(rows: DataFrame, column: str, version: str) -> DataFrame:
    """Rows that another version of a parser made, or none."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(version)))


def to_do(sources: DataFrame, done: DataFrame, key: str, fingerprint: str | None = None, force: bool = False) -> DataFrame:
    """Sources that aren't done: all if forced, those of a key that is missing, or with a fingerprint also those that
    have another one since. Fingerprints compare with nulls equal."""
    if force:
        return sources
    keys = [key] if fingerprint is None else [key, fingerprint]
    known = done.select(*[F.col(k).alias(f"_d_{k}") for k in keys]).distinct()
    return sources.join(known, [F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in keys], "left_anti")


def preferred(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the first source, and those of the second whose key the first lacks."""
    return merge.insert_new(first, second, keys)


def seeded(log: DataFrame, entities: DataFrame, entity: str, key: str, version: str) -> DataFrame:
    """(entity_type, entity_key, change_type, version) of a first `create` for entities that the log doesn't know."""
    new = entities.select(F.lit(entity).alias("entity_type"), F.col(key).cast("string").alias("entity_key"), F.lit("create").alias("change_type"), F.col(version).cast("string").alias("version")).dropDuplicates(["entity_key"])
    return new.join(log.where(F.col("entity_type") == entity).select("entity_key").distinct(), "entity_key", "left_anti").select("entity_type", "entity_key", "change_type", "version")
