"""Searches over items, pages, comments and entities, and their fusion.

A search is a scan of the texts with the query as its predicate. What matched is ranked where it is found and goes on
as ids and scores; copies of a row are folded after that, and only the top rows fetch their texts. Totals are a separate
count, so no window runs over all rows in one task. The tables may hold exact copies of a row.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minutebook.functions import fulltext, fuzzy, text, vectors
from minutebook.functions.intent import FIRST_YEAR, LAST_YEAR, candidates, expand
from minutebook.session import cut

GROUPS = {"none": "id", "file": "file_number", "matter": "matter"}
ARRAYS = {"aye": "ayes", "no": "noes", "absent": "absent", "excused": "excused"}


@dataclass
class Options:
    query: str
    from_year: int = FIRST_YEAR
    to_year: int = LAST_YEAR
    kind: str | None = None
    voter: str | None = None
    position: str | None = None
    final: bool = False
    speaker: str | None = None
    group: str = "none"
    limit: int = 20
    expand: bool = True
    stems: bool = True
    #: Whether a title may also be near the query by word similarity.
    nearby: bool = True
    aliases: Mapping[str, Sequence[str]] | None = None

    def __post_init__(self) -> None:
        if not 2 <= len(self.query.strip()) <= 300:
            raise ValueError("a query has 2 to 300 characters")
        if self.position is not None and (self.position not in ARRAYS or self.voter is None):
            raise ValueError("a position is aye, no, absent or excused and needs a voter")
        if self.group not in GROUPS:
            raise ValueError("group is none, file or matter")
        if self.from_year > self.to_year or not 1 <= self.limit <= 50:
            raise ValueError("years or limit out of range")

    @property
    def queries(self) -> list[str]:
        """The query and its other ways to put it."""
        return [self.query, *(expand(self.query, self.aliases) if self.expand else [])]


def _analyse(c: Column, stems: bool) -> Column:
    return fulltext.stemmed(fulltext.analyse(c)) if stems else fulltext.analyse(c)


def _ranks(analysed: Column, queries: list[str], weight: float, rank: str, stems: bool) -> Column:
    words = fulltext.wanted(*queries, stems=stems)
    if not words:
        return F.lit(0.0)
    return fulltext.cover_density(words, weight)(analysed) if rank == "cover" else fulltext.frequency_rank(analysed, words, weight)


def voted(roll_calls: DataFrame, o: Options) -> DataFrame:
    """(item_id) of roll calls that meet the voter, position and final filters; names compare by name key."""
    r = roll_calls
    if o.final:
        r = r.where("is_final")
    if o.voter:
        names = F.col(ARRAYS[o.position]) if o.position else F.concat("ayes", "noes", "absent", "excused")
        key = text.name_key(F.lit(o.voter))
        r = r.where(F.exists(names, lambda x: text.name_key(x) == key))
    return r.select("item_id").distinct()


def _dated(documents: DataFrame, o: Options) -> DataFrame:
    """(document_id, meeting_date, kind) of the documents within the years, once each."""
    some = documents.where(F.col("year").between(o.from_year, o.to_year) & (F.col("kind") == o.kind if o.kind else F.lit(True)))
    return some.groupBy(F.col("id").alias("document_id")).agg(F.max("meeting_date").alias("meeting_date"), F.max("kind").alias("kind"))


def _texts_of(top: DataFrame, rows: DataFrame, key: str, *texts: str) -> DataFrame:
    """top with texts of its rows, fetched by id; top is a page of results."""
    few = F.broadcast(top.select(F.col(key).alias("_id")))  # at most a page of rows
    found = rows.join(few, F.col("id") == F.col("_id"), "left_semi").groupBy(F.col("id").alias(key)).agg(*[F.max(c).alias(c) for c in texts])
    return top.join(found, key)


def items(items: DataFrame, documents: DataFrame, roll_calls: DataFrame, o: Options, rank: str = "frequency") -> DataFrame:
    """(item_id, document_id, meeting_date, file_number, title, content, start_page, end_page, score, group_count,
    total, rank), best first.

    Of each group of matches the newest row stands for it. Score: text and title rank, the query within the title, an
    equal file number, likeness of the title, and a little for a final vote."""
    queries, low = o.queries, o.query.lower()
    title = F.coalesce("title", F.lit(""))
    analysed = _analyse(F.concat(title, F.lit(" "), F.coalesce("content", F.lit(""))), o.stems)
    number = text.file_number(F.lit(o.query))
    hit = fulltext.matches(analysed, *queries, stems=o.stems) | F.coalesce(F.col("file_number") == number, F.lit(False))
    likeness = fuzzy.similarity(F.lower(title), F.lit(low))
    if o.nearby:
        likeness = F.greatest(likeness, fuzzy.word_similarity(low)(F.lower(title)))
    score = (
        1.8 * _ranks(analysed, queries, 0.4, rank, o.stems) + 3.2 * _ranks(_analyse(title, o.stems), queries, 1.0, rank, o.stems)
        + F.when(F.lower(title).contains(low), 2.5).otherwise(0.0) + F.when(F.col("file_number") == number, 8.0).otherwise(0.0) + 0.7 * likeness
    )
    group = F.coalesce(F.col(GROUPS[o.group]).cast("string"), F.concat(F.lit("#"), F.col("id").cast("string")))
    found = items.where(hit).select("id", "document_id", "ordinal", "file_number", "start_page", "end_page", group.alias("g"), score.alias("score")).dropDuplicates(["id"])
    found = found.join(_dated(documents, o), "document_id")
    if o.voter or o.final:
        found = found.join(voted(roll_calls, o).withColumnRenamed("item_id", "id"), "id", "left_semi")
    newest = F.struct("meeting_date", "ordinal", "id", "document_id", "file_number", "start_page", "end_page", "score")
    best = cut(found.groupBy("g").agg(F.max(newest).alias("r"), F.count("*").alias("group_count")).select("r.*", "group_count"))
    total = best.agg(F.count("*").alias("total"))
    finals = roll_calls.where("is_final").select(F.col("item_id").alias("id"), F.lit(0.12).alias("has_final")).distinct()
    best = best.join(finals, "id", "left").withColumn("score", F.round(F.col("score") + F.coalesce("has_final", F.lit(0.0)), 6))
    order = (F.desc("score"), F.desc("meeting_date"), F.asc("id"))
    top = best.orderBy(*order).limit(o.limit).withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumnRenamed("id", "item_id")
    top = _texts_of(cut(top.crossJoin(F.broadcast(total))), items, "item_id", "title", "content")
    return top.select("item_id", "document_id", "meeting_date", "file_number", "title", "content", "start_page", "end_page", "score", "group_count", "total", "rank").orderBy("rank")


#: A query of letters alone, of at most so many words, is worth correcting.
CORRECTED_WORDS = 6


def respelled(items: DataFrame, query: str) -> str | None:
    """The query with each word that no title has put right by one edit, or None where nothing changes. Only queries of
    letters with at most six words are tried; what reaches the driver is a row a word."""
    words = query.lower().split()
    if len(words) > CORRECTED_WORDS or not all(re.fullmatch("[a-z]+", w) for w in words):
        return None
    spark = items.sparkSession
    rows = fuzzy.corrections(spark.createDataFrame([(w,) for w in words], "word string"), fuzzy.vocabulary(items.where("title is not null"), "title")).collect()
    right = {r.word: r.correction for r in rows}
    put = " ".join(right.get(w, w) for w in words)
    return put if put != " ".join(words) else None


def items_or_respelled(items_: DataFrame, documents: DataFrame, roll_calls: DataFrame, o: Options, rank: str = "frequency") -> DataFrame:
    """items(), with a column correction: null, or the query that was searched instead because the given one found
    nothing."""
    found, correction = cut(items(items_, documents, roll_calls, o, rank)), None
    if found.limit(1).count() == 0 and (correction := respelled(items_, o.query)):
        found = items(items_, documents, roll_calls, replace(o, query=correction), rank)
    return found.withColumn("correction", F.lit(correction).cast("string"))


def pages(pages: DataFrame, documents: DataFrame, items: DataFrame, o: Options, rank: str = "frequency") -> DataFrame:
    """(page_id, document_id, page_number, meeting_date, content, score, item_id, rank), best first: with the item of a
    page of minutes that its page range holds, one that matches before others, then by ordinal."""
    queries = o.queries
    analysed = _analyse(F.col("content"), o.stems)
    found = pages.where(fulltext.matches(analysed, *queries, stems=o.stems)).select(F.col("id").alias("page_id"), "document_id", "page_number", F.round(_ranks(analysed, queries, 0.1, rank, o.stems), 6).alias("score"))
    order = (F.desc("score"), F.desc("meeting_date"), F.asc("page_number"), F.asc("page_id"))
    top = found.dropDuplicates(["page_id"]).join(_dated(documents, o), "document_id").orderBy(*order).limit(o.limit)
    top = cut(top.withColumn("rank", F.row_number().over(Window.orderBy(*order))))
    few = F.broadcast(top.where(F.col("kind") == "minutes").select("page_id", F.col("document_id").alias("_d"), F.col("page_number").alias("_p")))  # at most a page of rows
    near = items.join(few, (F.col("document_id") == F.col("_d")) & F.col("_p").between(F.col("start_page"), F.col("end_page")))
    fits = fulltext.matches(_analyse(F.concat_ws(" ", "title", "content"), o.stems), *queries, stems=o.stems)
    one = near.groupBy("page_id").agg(F.min_by("id", F.struct(~fits, F.col("ordinal"), F.col("id"))).alias("item_id"))
    return _texts_of(top.join(one, "page_id", "left"), pages, "page_id", "content").select("page_id", "document_id", "page_number", "meeting_date", "content", "score", "item_id", "rank").orderBy("rank")


def comments(comments: DataFrame, documents: DataFrame, o: Options, rank: str = "frequency") -> DataFrame:
    """(comment_id, document_id, meeting_date, speaker, page_number, content, score, rank), best first; a speaker filter
    takes its text literally, in any case."""
    queries = o.queries
    said, speaker = _analyse(F.coalesce("content", F.lit("")), o.stems), _analyse(F.coalesce("speaker", F.lit("")), o.stems)
    hit = fulltext.matches(_analyse(F.concat_ws(" ", F.coalesce("speaker", F.lit("")), F.coalesce("content", F.lit(""))), o.stems), *queries, stems=o.stems)
    found = comments.where(hit)
    if o.speaker:
        found = found.where(F.lower("speaker").contains(o.speaker.lower()))
    score = F.round(_ranks(speaker, queries, 1.0, rank, o.stems) + _ranks(said, queries, 0.4, rank, o.stems), 6)
    found = found.select(F.col("id").alias("comment_id"), "document_id", "speaker", "page_number", "ordinal", score.alias("score")).dropDuplicates(["comment_id"])
    order = (F.desc("score"), F.desc("meeting_date"), F.asc("ordinal"), F.asc("comment_id"))
    top = found.join(_dated(documents, o), "document_id").orderBy(*order).limit(o.limit)
    top = cut(top.withColumn("rank", F.row_number().over(Window.orderBy(*order))))
    return _texts_of(top, comments, "comment_id", "content").select("comment_id", "document_id", "meeting_date", "speaker", "page_number", "content", "score", "rank").orderBy("rank")


def entity_matches(entities: DataFrame, items: DataFrame, query: str, limit: int, stems: bool = True) -> DataFrame:
    """(file_number, matched_values, score): files whose entities match the query as words, as a part, or by word
    similarity of 0.62; at most five values each."""
    plain = query.lower()
    for a, b in (("street", "st"), ("avenue", "ave"), ("boulevard", "blvd")):
        plain = " ".join(b if w == a else w for w in plain.split())
    plain = " ".join(w for w in plain.replace('"', " ").replace("(", " ").replace(")", " ").split() if w != "or")
    e = entities.withColumn("near", fuzzy.word_similarity(plain)(F.col("normalized_value")))
    hit = fulltext.matches(_analyse(F.concat_ws(" ", "display_value", "normalized_value"), stems), query, stems=stems) | F.col("normalized_value").contains(plain) | (F.col("near") >= 0.62)
    e = e.where(hit).withColumn("s", F.greatest("near", fuzzy.similarity(F.col("normalized_value"), F.lit(plain))))
    rows = e.join(items.select(F.col("id").alias("item_id"), "file_number"), "item_id").where(F.col("file_number").isNotNull())
    out = rows.groupBy("file_number").agg(F.slice(F.array_sort(F.collect_set("display_value")), 1, 5).alias("matched_values"), F.round(F.max("s"), 6).alias("score"))
    return out.orderBy(F.desc("score"), "file_number").limit(limit)


def unified(found_items: DataFrame, found_comments: DataFrame, found_pages: DataFrame, entities: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """(key, list_no, cosine, fusion): candidates of all kinds by reciprocal rank; an item whose file an entity names
    gains 1.25 before ranks are given. semantic: (key, cosine) of items by vector."""
    boosted = found_items.join(entities.select("file_number", F.lit(1.25).alias("b")), "file_number", "left")
    rows = boosted.select(F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("key"), F.lit(1).alias("list_no"), (F.col("score") + F.coalesce("b", F.lit(0.0))).alias("score"))
    rows = rows.unionByName(found_comments.select(F.concat(F.lit("comment:"), F.col("comment_id").cast("string")).alias("key"), F.lit(2).alias("list_no"), "score"))
    rows = rows.unionByName(found_pages.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("key"), F.lit(3).alias("list_no"), "score"))
    return vectors.fuse(rows, semantic, F.col("list_no") == 1, limit)


def hydrated(fused: DataFrame, items: DataFrame, documents: DataFrame, o: Options) -> DataFrame:
    """fused results with what an item's row shows, also for those that only their vectors found: (key, list_no, cosine,
    fusion, result_type, item_id, title, file_number, meeting_date). Items outside the years asked for are left out."""
    i = items.select(F.concat(F.lit("item:"), F.col("id").cast("string")).alias("key"), F.col("id").alias("item_id"), "document_id", "title", "file_number").dropDuplicates(["key"])
    i = i.join(_dated(documents, replace(o, kind=None)).drop("kind"), "document_id").drop("document_id")
    few = F.broadcast(fused)  # a page of results
    rows = few.join(i, "key", "left")
    return rows.withColumn("result_type", result_type()).where((~F.col("key").startswith("item:")) | F.col("item_id").isNotNull())


def retrieval_mode(asked: str, vectors_held: int | None) -> tuple[str, str | None]:
    """(mode, reason) of a search: hybrid where vectors are there to be asked, else lexical with the reason why."""
    if asked != "hybrid":
        return "lexical", None
    if vectors_held is None:
        return "lexical", "no provider of vectors"
    return ("hybrid", None) if vectors_held else ("lexical", "no vectors are stored")


def result_type() -> Column:
    return F.when(F.col("list_no") == 2, "comments").when(F.col("list_no") == 3, "pages").when(F.col("list_no") == 1, "items").otherwise("semantic")


def facets(fused: DataFrame) -> DataFrame:
    """(result_type, n) over the candidates."""
    return fused.groupBy(result_type().alias("result_type")).agg(F.count("*").alias("n"))


def preview(rows: DataFrame, column: str, query: str, limit: int | None = None) -> DataFrame:
    """Rows that contain any word of the query, by how many words they contain."""
    words = [w for w in query.lower().split() if w]
    n = sum((F.lower(F.col(column)).contains(w).cast("int") for w in words), F.lit(0))
    found = rows.withColumn("hits", n).where("hits > 0").orderBy(F.desc("hits"), *rows.columns[:1])
    return found if limit is None else found.limit(limit)


def budget(limit: int) -> int:
    return candidates(limit)
