"""Identifiers of documents, the events they name, and public snapshots of all kinds of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMES = {"event-id": "event_id", "event-guid": "event_guid", "official-url": "official_url"}


def identifiers(documents: DataFrame) -> DataFrame:
    """(document_id, scheme, value): each identifier of a document that isn't null, once, from one scan."""
    pairs = F.array(*[F.struct(F.lit(scheme).alias("scheme"), F.col(c).cast("string").alias("value")) for scheme, c in SCHEMES.items()])
    return documents.select(F.col("id").alias("document_id"), F.explode(pairs).alias("i")).select("document_id", "i.*").where(F.col("value").isNotNull()).distinct()


def events(documents: DataFrame) -> DataFrame:
    """(event_id, event_guid, event_date, agenda_url, minutes_url) of each event that documents name: its first date,
    the least guid, and the greatest URL of each kind."""
    url = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("official_url"))).alias(f"{kind}_url")
    return documents.where(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.min("event_guid").alias("event_guid"), F.min("meeting_date").alias("event_date"), url("agenda"), url("minutes"))


def with_parent(children: DataFrame, parents: DataFrame, natural: list[str], key: str) -> DataFrame:
    """Children with the key of the parent that has the same natural key; those without a parent are left out."""
    ids = parents.groupBy(*natural).agg(F.min("id").alias(key))
    return children.join(ids, natural)


def version_list(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """versions, newest first within a document, with the name and version of the parser that made them, if known."""
    known = runs.groupBy(F.col("id").alias("parser_run_id")).agg(F.max(F.struct("parser_name", "parser_version")).alias("r"))
    return versions.join(known, "parser_run_id", "left").select(*versions.columns, "r.parser_name", "r.parser_version").orderBy("document_id", F.desc("version_number"))


def supervisor_snapshot(supervisors: DataFrame, aliases: DataFrame) -> DataFrame:
    """Members with their other names, the longest first, empty where there are none; contact is what their metadata
    says of it."""
    named = aliases.groupBy("supervisor_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("alias")).alias("l"), "alias", "confidence"))).alias("a"))
    s = supervisors.join(named, supervisors["id"] == named["supervisor_id"], "left")
    listed = F.transform("a", lambda x: F.struct(x["alias"].alias("alias"), x["confidence"].alias("confidence")))
    none = F.array().cast("array<struct<alias:string,confidence:double>>")
    return s.select(
        F.col("id").cast("string").alias("id"), "slug", F.col("display_name").alias("displayName"), F.col("family_name").alias("familyName"), "district", F.col("term_start").cast("string").alias("termStart"), F.col("term_end").cast("string").alias("termEnd"),
        F.col("legistar_person_id").cast("string").alias("personId"), "active", F.get_json_object("metadata", "$.contact").alias("contact"), F.coalesce(listed, none).alias("aliases"),
    )


def position_snapshot(positions: DataFrame, supervisors: DataFrame, items: DataFrame, roll_calls: DataFrame) -> DataFrame:
    """Recorded positions, as votes.reconciled() gives them, with the member's slug (null for nobody), the action, and
    the file, document and page of the item."""
    s = supervisors.select(F.col("id").alias("supervisor_id"), F.col("slug").alias("supervisorSlug"))
    i = items.select(F.col("id").alias("item_id"), F.col("file_number").alias("fileNumber"), F.col("document_id").cast("string").alias("documentId"), F.col("start_page").alias("page")).dropDuplicates(["item_id"])
    r = roll_calls.select(F.col("id").alias("roll_call_id"), "item_id", "action").dropDuplicates(["roll_call_id"])
    called = r.join(i, "item_id").drop("item_id")  # by roll call, as positions are many more
    p = positions.join(s, "supervisor_id", "left").join(called, "roll_call_id")
    return p.select(
        F.concat_ws(":", "roll_call_id", "position", "recorded_name").alias("id"), "supervisorSlug", F.col("recorded_name").alias("recordedName"), "position", F.col("confidence").cast("double").alias("confidence"), "action",
        F.col("action_type").alias("actionType"), F.col("is_final").alias("isFinal"), "fileNumber", F.col("meeting_date").cast("string").alias("meetingDate"), "documentId", "page",
    )


def file_snapshot(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Legislative files: number, matter's key, title of the newest item, first and last date."""
    dated = items.where(F.col("file_number").isNotNull()).select("file_number", "document_id", "ordinal", "id", "title", "legislative_file_id").dropDuplicates(["id"])
    dated = dated.join(documents.select(F.col("id").alias("document_id"), "meeting_date").distinct(), "document_id")
    newest = F.max(F.struct("meeting_date", "ordinal", "id", "title")).alias("r")
    f = dated.groupBy("file_number").agg(newest, F.min("meeting_date").alias("first"), F.max("legislative_file_id").alias("file"))
    return f.select(F.col("file_number").alias("fileNumber"), F.col("file").cast("string").alias("fileId"), F.col("r.title").alias("title"), F.col("first").cast("string").alias("firstSeenDate"), F.col("r.meeting_date").cast("string").alias("lastSeenDate"))
