"""Answers with their evidence: recorded votes, roll calls that bear on them, bundles, documents and members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minutebook.functions import fulltext
from minutebook.functions.intent import HOUSING_QUERY, Intent
from minutebook.functions.text import name_key
from minutebook.operators import search, votes
from minutebook.operators.search import ARRAYS
from minutebook.session import cut


def member_votes(roll_calls: DataFrame, items: DataFrame, documents: DataFrame, supervisors: DataFrame, voter: str) -> DataFrame:
    """(supervisor_id, roll_call_id, item_id, sequence, action, action_type, is_final, position, recorded_name,
    confidence, meeting_date, ordinal, file_number, title): the recorded positions of the one member a name means.

    The member is resolved first: only spellings under which that member may be recorded are looked for in the roll
    calls, so that no other positions are exploded or joined. What the spellings then mean on the day is settled as for
    all members."""
    who = votes.resolve(supervisors, voter)
    keys = votes.aliases(supervisors).select("supervisor_id", F.col("normalized_alias").alias("k")).unionByName(supervisors.select(F.col("id").alias("supervisor_id"), name_key(F.col("family_name")).alias("k")))
    keys = keys.join(who.select("supervisor_id"), "supervisor_id", "left_semi").agg(F.collect_set("k").alias("keys"))  # one row
    few = roll_calls.crossJoin(F.broadcast(keys))
    for c in ARRAYS.values():
        few = few.withColumn(c, F.filter(c, lambda x: F.array_contains("keys", name_key(x))))
    few = few.where(F.size(F.concat(*ARRAYS.values())) > 0).drop("keys")
    i = items.select(F.col("id").alias("item_id"), "document_id", "ordinal", "file_number", "title").dropDuplicates(["item_id"])
    dated = i.join(documents.select(F.col("id").alias("document_id"), "meeting_date").distinct(), "document_id").drop("document_id")
    own = votes.reconciled(votes.positions(few), dated.select("item_id", "meeting_date"), supervisors).join(who.select("supervisor_id"), "supervisor_id", "left_semi")
    actions = few.select(F.col("id").alias("roll_call_id"), "action").dropDuplicates(["roll_call_id"])
    return own.join(dated.drop("meeting_date"), "item_id").join(actions, "roll_call_id")


def vote_aggregate(own: DataFrame, from_year: int = 1996, to_year: int = 2100, position: str | None = None, final: bool = False, by_file: bool = True, query: Column | None = None, limit: int = 100) -> DataFrame:
    """member_votes() narrowed, the newest of each file (or each position of its own), newest first, `limit` rows, each
    with total, the number of all groups. Order: meeting_date, file_number and roll_call_id, all descending.
    query: a condition on the columns of own, as a text restriction."""
    rows = own.where(F.year("meeting_date").between(from_year, to_year))
    if position is not None:
        rows = rows.where(F.col("position") == position)
    if final:
        rows = rows.where("is_final")
    if query is not None:
        rows = rows.where(query)
    single = F.concat(F.lit("#"), F.col("roll_call_id").cast("string"), F.lit(" "), F.col("position"))
    last = cut(votes.latest_votes(rows, F.coalesce("file_number", single) if by_file else single))
    total = last.agg(F.count("*").alias("total"))
    order = (F.desc("meeting_date"), F.desc_nulls_last("file_number"), F.desc("roll_call_id"))
    return last.orderBy(*order).limit(limit).crossJoin(F.broadcast(total)).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def counts(page: DataFrame, own: DataFrame) -> DataFrame:
    """One row: the positions of a page of vote_aggregate() over its rows, and of all positions of the member."""
    names = [F.col(p).alias(f"all_{p}") for p in votes.POSITIONS]
    return votes.histogram(page).crossJoin(F.broadcast(votes.histogram(own).select(*names)))  # one row each


def housing_aggregate(page: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: of the files of a page of vote_aggregate() those with and without a unit count, the sum of each file's
    greatest, and the addresses. facts: (item_id, housing_units, addresses); an item with several has them together."""
    f = facts.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("housing_units"))).alias("units"), F.array_distinct(F.flatten(F.collect_list("addresses"))).alias("addresses"))
    none = lambda c: F.coalesce(c, F.array().cast(f.schema[c].dataType)).alias(c)
    return votes.housing(page.join(f, "item_id", "left").select(none("units"), none("addresses")))


def housing_titles(content: Column) -> Column:
    """Whether a text speaks of housing units."""
    return fulltext.matches(fulltext.analyse(content), HOUSING_QUERY)


def nested_calls(roll_calls: DataFrame) -> DataFrame:
    """(item_id, calls): the roll calls of each item in order, as one array."""
    own = roll_calls.select("item_id", F.struct("sequence", "id", "action", "action_type", "is_final", *ARRAYS.values()).alias("c")).dropDuplicates(["item_id", "c"])
    return own.groupBy("item_id").agg(F.sort_array(F.collect_list("c")).alias("calls"))


def _fits(c: Column, voter: str | None, position: str | None) -> Column:
    if voter is None:
        return F.lit(True)
    key = name_key(F.lit(voter))
    names = c[ARRAYS[position]] if position else F.concat(*[c[x] for x in ARRAYS.values()])
    return F.exists(names, lambda x: name_key(x) == key)


def shown_call(calls: Column, voter: str | None = None, position: str | None = None) -> Column:
    """The roll call to show of an item: the first final one in which the voter took the position, else the first final
    one, else the first; null where there is none."""
    first = lambda keep: F.get(F.filter(calls, keep), F.lit(0))
    return F.coalesce(first(lambda c: c["is_final"] & _fits(c, voter, position)), first(lambda c: c["is_final"]), F.get(calls, F.lit(0)))


def relevant_calls(calls: Column, voter: str | None = None, position: str | None = None) -> Column:
    """The roll calls that bear on a question: those in which the voter took the position, else the first two; without
    a voter the first four."""
    if voter is None:
        return F.slice(calls, 1, 4)
    own = F.filter(calls, lambda c: _fits(c, voter, position))
    return F.when(F.size(own) > 0, own).otherwise(F.slice(calls, 1, 2))


def bundle(intent: Intent, items: DataFrame, pages: DataFrame, comments: DataFrame, documents: DataFrame, roll_calls: DataFrame, supervisors: DataFrame, facts: DataFrame, o: search.Options | None = None) -> DataFrame:
    """(part, rank, id, title, body): the evidence for a question, as one table. Twelve items, one a matter, with the
    roll calls that bear on it; eight pages; eight comments if it asks for them; and the housing of a member's votes if
    it asks for that. body is JSON."""
    base = o or search.Options(intent.query, from_year=intent.from_year, to_year=intent.to_year)
    by = lambda **more: search.Options(**{**base.__dict__, **more})
    voting = {"voter": intent.voter, "position": intent.position if intent.voter else None, "final": intent.final}
    found = search.items(items, documents, roll_calls, by(group="matter", limit=12, **voting))
    calls = nested_calls(roll_calls.join(F.broadcast(found.select("item_id")), "item_id", "left_semi"))  # a page of items
    found = found.join(calls, "item_id", "left").withColumn("calls", relevant_calls(F.col("calls"), intent.voter, voting["position"]))
    part = lambda df, name, key, title, *body: df.select(F.lit(name).alias("part"), F.col("rank"), F.col(key).cast("string").alias("id"), F.col(title).cast("string").alias("title"), F.to_json(F.struct(*body)).alias("body"))
    out = part(found, "item", "item_id", "title", "file_number", "meeting_date", "score", "group_count", "calls")
    out = out.unionByName(part(search.pages(pages, documents, items, by(limit=8)), "page", "page_id", "meeting_date", "document_id", "page_number", "item_id", "score"))
    if intent.comments:
        out = out.unionByName(part(search.comments(comments, documents, by(limit=8)), "comment", "comment_id", "speaker", "document_id", "page_number", "content"))
    if intent.housing and intent.voter:
        own = member_votes(roll_calls, items, documents, supervisors, intent.voter)
        held = items.where(housing_titles(F.concat_ws(" ", "title", "content"))).select("id")
        own = own.join(held.select(F.col("id").alias("item_id")).distinct(), "item_id", "left_semi")
        page = vote_aggregate(own, intent.from_year, intent.to_year, voting["position"], intent.final)
        whole = housing_aggregate(page, facts).select(F.lit("housing").alias("part"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("id"), F.lit(intent.voter).alias("title"), F.to_json(F.struct("*")).alias("body"))
        out = out.unionByName(whole)
    return out


def document_evidence(document_id: int, documents: DataFrame, pages: DataFrame, items: DataFrame, roll_calls: DataFrame, spans: DataFrame, versions: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """(part, position, id, body) of one document: its row with the newest version, its pages from first to last, and
    the items whose pages meet these, with their roll calls and the greatest confidence of their spans. spans:
    (entity_type, entity_id, confidence, parser_version), items by their id as text. body is JSON."""
    last = 2**31 - 1 if last is None else last
    newest = versions.where(F.col("document_id") == document_id).groupBy("document_id").agg(F.max(F.struct("version_number", "content_sha256")).alias("version"), F.count("*").alias("versions"))
    d = documents.where(F.col("id") == document_id).dropDuplicates(["id"]).join(newest.withColumnRenamed("document_id", "id"), "id", "left")
    out = d.select(F.lit("document").alias("part"), F.lit(0).alias("position"), F.col("id").cast("string").alias("id"), F.to_json(F.struct("kind", "title", "meeting_date", "version", "versions")).alias("body"))
    p = pages.where((F.col("document_id") == document_id) & F.col("page_number").between(first, last)).dropDuplicates(["id"])
    out = out.unionByName(p.select(F.lit("page").alias("part"), F.col("page_number").alias("position"), F.col("id").cast("string").alias("id"), F.to_json(F.struct("content")).alias("body")))
    i = items.where((F.col("document_id") == document_id) & (F.col("end_page") >= first) & (F.col("start_page") <= last)).dropDuplicates(["id"])
    few = i.select(F.col("id").alias("item_id"))
    calls = nested_calls(roll_calls.join(few, "item_id", "left_semi"))
    sure = spans.where("entity_type = 'item'").groupBy(F.col("entity_id").alias("key")).agg(F.max("confidence").alias("confidence"), F.max("parser_version").alias("parser_version"))
    i = i.withColumn("key", F.col("id").cast("string")).join(calls.withColumnRenamed("item_id", "id"), "id", "left").join(sure, "key", "left")
    calls_or_none = F.coalesce("calls", F.array().cast(calls.schema["calls"].dataType)).alias("calls")
    return out.unionByName(i.select(F.lit("item").alias("part"), F.col("ordinal").alias("position"), "id", F.to_json(F.struct("file_number", "title", "start_page", "end_page", "confidence", "parser_version", calls_or_none)).alias("body")).withColumn("id", F.col("id").cast("string")))


def member_profile(own: DataFrame, aliases: DataFrame, newest: int = 250) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(positions, votes, aliases) of one member from member_votes(): counts and dates by position, the newest votes by
    meeting date, ordinal and sequence, and the spellings of the name, the surest first."""
    by_position = own.groupBy("position").agg(F.count("*").alias("n"), F.min("meeting_date").alias("first_vote"), F.max("meeting_date").alias("last_vote"))
    order = (F.desc("meeting_date"), F.desc("ordinal"), F.desc("sequence"), F.desc("roll_call_id"), F.asc("position"))
    recent = own.orderBy(*order).limit(newest).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    names = aliases.join(own.select("supervisor_id").distinct(), "supervisor_id", "left_semi").select("alias", "confidence").orderBy(F.desc("confidence"), "alias")
    return by_position, recent, names
