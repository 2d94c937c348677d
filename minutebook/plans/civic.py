"""Searches, extraction, versions and vote aggregates on the civic tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minutebook.functions import extract, fulltext, fuzzy, linking, text, vectors
from minutebook.functions.intent import interpret
from minutebook.operators import evidence, feed, identifiers, jobs, parsers, postings, search, versions, votes
from minutebook.session import cut, stored, table
from minutebook.sources import records

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def once(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """A civic table without its exact copies; only the columns named are read."""
    rows = table(spark, sf, name)
    if columns:
        rows = rows.select("id", *columns)
    return rows.dropDuplicates(["id"])


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "legislative_items")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "meeting_documents")


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "roll_calls")


D = "(select distinct * from meeting_documents)"
I = "(select distinct * from legislative_items)"
C = "(select distinct * from roll_calls)"
P = "(select distinct * from pages)"
N = "(select distinct * from public_comments)"
_A = lambda x: f"' ' || trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')) || ' '"
_TF = lambda t, w: f"ln(1.0 + len(list_filter(string_split(trim({t}), ' '), lambda x: x = '{w}')))"


def _rank_sql(t: str, words: list[str], weight: float) -> str:
    r = f"{weight} * ({' + '.join(_TF(t, w) for w in words)})"
    return f"({r}) / (1 + {r})"


_ITEM_WORDS = ["overtime", "costs"]
_GRAMS = lambda x: f"list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"

ITEM_SEARCH_SQL = f"""
with d as {D}, i as (select *, {_A("coalesce(title, '') || ' ' || coalesce(content, '')")} as t, {_A("coalesce(title, '')")} as h from {I}),
f as (
  select i.*, d.meeting_date, coalesce(i.file_number, '#' || cast(i.id as varchar)) as g from i join d on d.id = i.document_id
  where contains(t, ' overtime ') and contains(t, ' costs ') and d.year between 2000 and 2026
), k as (
  select *, row_number() over (partition by g order by meeting_date desc, ordinal desc, id desc) as gr, count(*) over (partition by g) as group_count from f
), fin as (select distinct item_id from {C} where is_final),
s as (
  select k.id as item_id, k.document_id, k.meeting_date, k.file_number, group_count, count(*) over () as total,
    round(1.8 * {_rank_sql("t", _ITEM_WORDS, 0.4)} + 3.2 * {_rank_sql("h", _ITEM_WORDS, 1.0)} + case when contains(lower(coalesce(title, '')), 'overtime costs') then 2.5 else 0 end
      + 0.7 * case when len(list_distinct(list_concat({_GRAMS("coalesce(title, '')")}, {_GRAMS("'overtime costs'")}))) > 0
          then len(list_intersect({_GRAMS("coalesce(title, '')")}, {_GRAMS("'overtime costs'")})) / len(list_distinct(list_concat({_GRAMS("coalesce(title, '')")}, {_GRAMS("'overtime costs'")}))) else 0 end
      + case when fin.item_id is not null then 0.12 else 0 end, 6) as score
  from k left join fin on fin.item_id = k.id where gr = 1
)
select item_id, document_id, meeting_date, file_number, score, group_count, total, row_number() over (order by score desc, meeting_date desc, item_id) as rank from s qualify rank <= 20"""


def _search_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf, "legislative_items"), table(spark, sf, "meeting_documents"), table(spark, sf, "roll_calls")


_FOUND = ("item_id", "document_id", "meeting_date", "file_number", "score", "group_count", "total", "rank")
_PLAIN_MODE = {"expand": False, "stems": False, "nearby": False}


@query(ITEM_SEARCH_SQL)
def s02_item_search(spark: SparkSession, sf: str) -> DataFrame:
    o = search.Options("overtime costs", from_year=2000, group="file", **_PLAIN_MODE)
    return search.items(*_search_tables(spark, sf), o).select(*_FOUND)


@query()
def s02_item_search_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """Other forms of the words match too."""
    o = search.Options("library hearing", from_year=2000, group="file", expand=False)
    return search.items(*_search_tables(spark, sf), o).select(*_FOUND)


@query(f"""
with i as (select *, {_A("coalesce(title, '') || ' ' || coalesce(content, '')")} as t from {I})
select id as item_id from i where contains(t, ' shoreline ') and contains(t, ' 960001 ') or file_number = '960001'""")
def s02_item_search_number(spark: SparkSession, sf: str) -> DataFrame:
    """A number of six digits finds its file whatever the other words."""
    i, d, r = _search_tables(spark, sf)
    o = search.Options("shoreline 960001", limit=50, **_PLAIN_MODE)
    found = search.items(i, d, r, o)
    every = postings.search(cut(postings.postings(i.select("id", F.concat_ws(" ", "title", "content").alias("t")), "id", {"t": 1.0})), o.query)
    mine = i.where(F.col("file_number") == "960001").select(F.col("id").alias("item_id")).union(every.select("key")).distinct()
    return mine.join(found.agg(F.max("total").alias("total")), F.col("total") > 0).select("item_id")


@query(f"""
with i as (select *, {_A("coalesce(title, '') || ' ' || coalesce(content, '')")} as t from {I})
select i.id as item_id from i join {D} d on d.id = i.document_id where (contains(t, ' construction ') and contains(t, ' agreement ') and contains(t, ' dormitory ') or contains(t, ' construction ') and contains(t, ' contracts ') and contains(t, ' dormitory ')) and d.year between 1996 and 2026""")
def s02_item_search_expanded(spark: SparkSession, sf: str) -> DataFrame:
    """The query and its other ways to put it, over the index."""
    i, d, _ = _search_tables(spark, sf)
    o = search.Options("construction contracts dormitory", stems=False)
    index = cut(postings.postings(i.select("id", F.concat_ws(" ", "title", "content").alias("t")), "id", {"t": 1.0}))
    found = postings.search(index, *o.queries).select(F.col("key").alias("id"))
    dated = d.where(F.col("year").between(1996, 2026)).select(F.col("id").alias("document_id")).distinct()
    return i.select("id", "document_id").distinct().join(found, "id").join(dated, "document_id", "left_semi").select(F.col("id").alias("item_id"))


@query(ITEM_SEARCH_SQL.replace("select item_id, document_id", "select 'overtime costs' as correction, item_id, document_id"))
def s02_item_search_misspelled(spark: SparkSession, sf: str) -> DataFrame:
    """A query that finds nothing is put right by the words of the titles."""
    o = search.Options("overtmie cossts", from_year=2000, group="file", **_PLAIN_MODE)
    return search.items_or_respelled(*_search_tables(spark, sf), o).select("correction", *_FOUND)


@query(f"""
with p as (select *, {_A("content")} as t from {P} where content is not null)
select id as page_id from p where contains(t, ' boulevard budget ') and not contains(t, ' hospital ') or contains(t, ' graffiti abatement ')""")
def s01_page_index(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases, alternatives and exclusions from postings."""
    index = cut(postings.postings(table(spark, sf, "pages"), "id", {"content": 0.1}))
    return postings.search(index, '"boulevard budget" -hospital OR "graffiti abatement"').select(F.col("key").alias("page_id"))


@query(f"""
with v as (select distinct item_id from {C} where is_final and len(list_filter(ayes, lambda x: regexp_replace(lower(strip_accents(x)), '[^a-z0-9]', '', 'g') = 'nunarte')) > 0),
f as (select i.id, d.meeting_date, i.ordinal from {I} i join {D} d on d.id = i.document_id where contains({_A("coalesce(i.title, '') || ' ' || coalesce(i.content, '')")}, ' library ') and i.id in (select item_id from v))
select id as item_id, cast(1 as bigint) as group_count, count(*) over () as total from f""")
def s02_item_search_by_voter(spark: SparkSession, sf: str) -> DataFrame:
    o = search.Options("library", voter="Nunarte", position="aye", final=True, limit=50, **_PLAIN_MODE)
    return search.items(*_search_tables(spark, sf), o).select("item_id", "group_count", "total")


@query()
def s02_item_search_cover(spark: SparkSession, sf: str) -> DataFrame:
    """With cover density and snippets on the top rows."""
    o = search.Options('"night lighting" OR "tenant relocation" -parking', limit=20)
    found = search.items(*_search_tables(spark, sf), o, rank="cover")
    cut = fulltext.headline(fulltext.wanted(*o.queries, stems=True), 80, 30, 2, stems=True)
    return found.select("item_id", "title", "score", "rank", cut(F.col("content")).alias("snippet"))


@query(f"""
with d as {D}, p as (select *, {_A("content")} as t from {P} where content is not null), i as {I},
f as (
  select p.id as page_id, p.document_id, p.page_number, d.meeting_date, d.kind, round({_rank_sql("t", ["boulevard", "budget"], 0.1)}, 6) as score
  from p join d on d.id = p.document_id where contains(t, ' boulevard budget ') and not contains(t, ' hospital ') and d.year between 1996 and 2026
), r as (select *, row_number() over (order by score desc, meeting_date desc, page_number, page_id) as rank from f qualify rank <= 20),
n as (
  select r.page_id, i.id as item_id, row_number() over (partition by r.page_id order by not (contains({_A("concat_ws(' ', i.title, i.content)")}, ' boulevard budget ') and not contains({_A("concat_ws(' ', i.title, i.content)")}, ' hospital ')), i.ordinal, i.id) as k
  from r join i on i.document_id = r.document_id and r.page_number between i.start_page and i.end_page where r.kind = 'minutes')
select r.page_id, r.document_id, r.page_number, r.meeting_date, r.score, n.item_id, r.rank from r left join n on n.page_id = r.page_id and n.k = 1""")
def s01_page_search(spark: SparkSession, sf: str) -> DataFrame:
    o = search.Options('"boulevard budget" -hospital', expand=False, stems=False)
    found = search.pages(table(spark, sf, "pages"), table(spark, sf, "meeting_documents"), table(spark, sf, "legislative_items"), o)
    return found.select("page_id", "document_id", "page_number", "meeting_date", "score", "item_id", "rank")


@query(f"""
with f as (
  select n.id as comment_id, n.document_id, d.meeting_date, n.ordinal, round({_rank_sql(_A("coalesce(speaker, '')"), ["hydrant", "kitchen"], 1.0)} + {_rank_sql(_A("coalesce(content, '')"), ["hydrant", "kitchen"], 0.4)}, 6) as score
  from {N} n join {D} d on d.id = n.document_id
  where (contains({_A("coalesce(speaker, '') || ' ' || coalesce(content, '')")}, ' hydrant ') or contains({_A("coalesce(speaker, '') || ' ' || coalesce(content, '')")}, ' kitchen ')) and contains(lower(speaker), 'a') and d.year between 1996 and 2026)
select comment_id, document_id, meeting_date, score, row_number() over (order by score desc, meeting_date desc, ordinal, comment_id) as rank from f qualify rank <= 20""")
def s03_comment_search(spark: SparkSession, sf: str) -> DataFrame:
    o = search.Options("hydrant OR kitchen", speaker="A", expand=False, stems=False)
    return search.comments(table(spark, sf, "public_comments"), table(spark, sf, "meeting_documents"), o).select("comment_id", "document_id", "meeting_date", "score", "rank")


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    """The entities of all items, extracted once for all queries of a session."""
    return stored(spark, f"entities {sf}", lambda: extract.entities(once(spark, sf, "legislative_items", "title", "content")))


def _item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(key, v): the vectors of all items, computed once for all queries of a session."""
    whole = F.concat_ws(" ", "title", "content")
    rows = lambda: once(spark, sf, "legislative_items", "title", "content").select(F.concat(F.lit("item:"), F.col("id").cast("string")).alias("key"), vectors.hash_embedder()(whole).alias("v"))
    return stored(spark, f"item vectors {sf}", rows)


@query()
def s04_entity_match(spark: SparkSession, sf: str) -> DataFrame:
    return search.entity_matches(_entities(spark, sf), table(spark, sf, "legislative_items").select("id", "file_number").distinct(), "Ziggimpock Foundation", 24)


@query()
def s05_unified_search(spark: SparkSession, sf: str) -> DataFrame:
    """Items, pages and comments with entities and vectors, fused by rank; the vectors of all items are ranked, and rows
    that only they find show their item."""
    intent = interpret("What about tenant relocation in 2015?", [])
    n = search.budget(20)
    o = search.Options(intent.query, from_year=intent.from_year, to_year=intent.to_year, limit=n)
    items, documents, calls = _search_tables(spark, sf)
    wanted = vectors.hash_embedder().func(pd.Series([intent.query]))[0]
    dated = documents.where(F.col("year").between(o.from_year, o.to_year)).select(F.col("id").alias("document_id"))
    within = items.join(dated, "document_id", "left_semi").select(F.concat(F.lit("item:"), F.col("id").cast("string")).alias("key"))
    semantic = vectors.nearest(_item_vectors(spark, sf).join(within, "key", "left_semi"), "key", "v", list(wanted), n).withColumnRenamed("score", "cosine")
    entities = search.entity_matches(_entities(spark, sf), items.select("id", "file_number").distinct(), intent.query, n)
    fused = search.unified(search.items(items, documents, calls, o), search.comments(table(spark, sf, "public_comments"), documents, o), search.pages(table(spark, sf, "pages"), documents, items, o), entities, semantic, 20)
    return search.hydrated(cut(fused), items, documents, o)


@query()
def ag18_facets(spark: SparkSession, sf: str) -> DataFrame:
    return search.facets(s05_unified_search(spark, sf))


@query("""select id as comment_id, cast(contains(lower(content), 'tree') as int) + cast(contains(lower(content), 'budget') as int) as hits from (select distinct * from public_comments) where contains(lower(content), 'tree') or contains(lower(content), 'budget')""")
def s09_preview(spark: SparkSession, sf: str) -> DataFrame:
    return search.preview(once(spark, sf, "public_comments", "content"), "content", "tree budget").select(F.col("id").alias("comment_id"), "hits")


@query(f"""
select id as item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(title, '') || chr(10) || coalesce(content, ''), '(?i)\\b([\\d,]+)\\s+(?:new\\s+|net\\s+|affordable\\s+|residential\\s+|dwelling\\s+|housing\\s+)*units?\\b', 1), lambda x: try_cast(replace(x, ',', '') as bigint)), lambda x: x > 0)))[1:20], ',') as units from {I}""")
def x07_housing_units(spark: SparkSession, sf: str) -> DataFrame:
    whole = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    units = F.array_join(F.transform(F.array_sort(extract.housing_units(whole)), lambda x: x.cast("string")), ",")
    return once(spark, sf, "legislative_items", "title", "content").select(F.col("id").alias("item_id"), units.alias("units"))


_SQUEEZE = lambda x: f"trim(regexp_replace({x}, '[\\s\\x{{a0}}]+', ' ', 'g'))"


@query("""
with t as (select o_orderkey, o_totalprice, case o_orderstatus when 'F' then 'not-to-exceed' when 'O' then 'increase' else 'revenue' end as qualifier from orders)
select o_orderkey, '$' || cast(cast(floor(o_totalprice) as bigint) as varchar) || '.5 million' as raw, (floor(o_totalprice) + 0.5) * 1e6 as value, qualifier from t
union all select o_orderkey, '$7k', 7000.0, case when qualifier = 'increase' then 'increase' when qualifier = 'revenue' then 'revenue' else 'stated' end from t""")
def x06_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts written into a sentence for each order come out with their value and kind."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.floor("o_totalprice").cast("string").alias("n"))
    before = F.when(F.col("o_orderstatus") == "F", "in an amount not to exceed ").when(F.col("o_orderstatus") == "O", "an increase of ").otherwise("with revenue of ")
    text_ = F.concat(F.lit("Grant "), before, F.lit("$"), "n", F.lit(".5  million, "), F.when(F.col("o_orderstatus") == "F", F.repeat(F.lit("word "), F.lit(30))).otherwise(""), F.lit("then $7k"))
    return o.select("o_orderkey", F.explode(extract.amounts(text_)).alias("a")).select("o_orderkey", "a.raw", "a.value", "a.qualifier")


@query()
def x06_item_amounts(spark: SparkSession, sf: str) -> DataFrame:
    whole = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    return once(spark, sf, "legislative_items", "title", "content").select(F.col("id").alias("item_id"), F.explode(extract.amounts(whole)).alias("a")).select("item_id", "a.*")


_BARE = lambda c: F.filter(F.transform(c, lambda x: F.trim(F.regexp_replace(text.squeeze(F.regexp_replace(x, "[,;.]", " ")), r"(?i)^(supervisors?\s+)+", ""))), lambda x: ~x.rlike(r"(?i)^(none|\d*)$"))
_BARE_SQL = lambda c: f"list_filter(list_transform({c}, lambda x: trim(regexp_replace({_SQUEEZE("regexp_replace(x, '[,;.]', ' ', 'g')")}, '(?i)^(supervisors?\\s+)+', ''))), lambda x: not regexp_matches(x, '(?i)^(none|\\d*)$'))"


@query(f"""
with n as (select *, {_BARE_SQL("ayes")} as names from {C})
select id as roll_call_id, array_to_string(names, ', ') as sponsors from n where len(names) > 0""")
def x10_sponsors(spark: SparkSession, sf: str) -> DataFrame:
    """The ayes of each roll call, written as sponsors over several lines, come out in one."""
    lines = F.concat(F.lit("An item\nSponsors: "), F.array_join("names", ",\n\n"), F.lit(";\nOrdinance of the matter\nSupervisor Nobody"))
    c = _calls(spark, sf).select(F.col("id").alias("roll_call_id"), _BARE(F.col("ayes")).alias("names")).where(F.size("names") > 0)
    return c.select("roll_call_id", extract.sponsors(lines).alias("sponsors"))


@query()
def x10_item_sponsors(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "legislative_items", "content").select(F.col("id").alias("item_id"), extract.sponsors(F.col("content")).alias("sponsors"))


@query()
def x11_entities(spark: SparkSession, sf: str) -> DataFrame:
    return extract.entities(once(spark, sf, "legislative_items", "title", "content"))


@query(f"""
select id as item_id, trim(lower(regexp_replace(regexp_replace(trim(regexp_replace(regexp_split_to_array(title, '\\s+-\\s+')[-1], '[\\s\\x{{a0}}]+', ' ', 'g')), '(?i)^proposed\\s+', ''), '[^A-Za-z0-9]+', ' ', 'g'))) as matter from {I} where title is not null""")
def x03_matter_key(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "legislative_items", "title").where("title is not null").select(F.col("id").alias("item_id"), text.matter_key(F.col("title")).alias("matter"))


@query(f"""
select id as roll_call_id, case when regexp_matches(action, 'FINALLY PASSED') then 'final-passage' when regexp_matches(action, 'FIRST READING') then 'first-reading' when regexp_matches(action, '\\bADOPTED\\b') then 'adoption'
  when regexp_matches(action, '\\bAPPROVED\\b') then 'approval' when regexp_matches(action, '(?i)\\bRESCIND') then 'rescission' when regexp_matches(action, '(?i)\\bCONTINU') then 'continuance' when regexp_matches(action, '(?i)\\bAMEND') then 'amendment'
  when regexp_matches(action, '(?i)\\bREFER') then 'referral' when regexp_matches(action, '(?i)\\bTABL') then 'tabling' when regexp_matches(action, '(?i)\\b(REJECT|FAIL|DENI)') then 'rejection' else 'other' end as action_type,
  not regexp_matches(action, 'FIRST READING') and regexp_matches(action, 'FINALLY PASSED|\\bADOPTED\\b|\\bAPPROVED\\b') as is_final from {C}""")
def x12_action_classes(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "roll_calls", "action").select(F.col("id").alias("roll_call_id"), text.action_type(F.col("action")).alias("action_type"), text.is_final(F.col("action")).alias("is_final"))


@query("""select id as supervisor_id, regexp_replace(lower(strip_accents(family_name)), '[^a-z0-9]', '', 'g') as key, regexp_replace(regexp_replace(lower(strip_accents(display_name)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from supervisors""")
def x14_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supervisors").select(F.col("id").alias("supervisor_id"), text.name_key(F.col("family_name")).alias("key"), text.slug(F.col("display_name")).alias("slug"))


_PLAIN = lambda x: F.trim(F.regexp_replace(text.squeeze(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\[\]\x00]", " ")), "^$", "none"))
_PLAIN_SQL = lambda x: f"trim(regexp_replace({_SQUEEZE(f"regexp_replace(coalesce({x}, ''), '[\\[\\]\\x00]', ' ', 'g')")}, '^$', 'none'))"


@query(f"""
select document_id, cast(row_number() over (partition by document_id order by ordinal, id) as int) as ordinal, lpad(cast(id % 1000000 as varchar), 6, '0') as file_number, {_PLAIN_SQL("title")} as title,
  length({_PLAIN_SQL("content")}) as length, 10 * ordinal as start_page from {I}""")
def x01_items_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Items written as the pages of their documents, a page for the header and one for the text, come out again."""
    i = _items(spark, sf).select("document_id", "id", "ordinal", _PLAIN(F.col("title")).alias("title"), _PLAIN(F.col("content")).alias("content"))
    head = F.concat(F.lpad((F.col("id") % 1000000).cast("string"), 6, "0"), F.lit("  ["), F.regexp_replace("title", " ", "\n"), F.lit("]"))
    pages = i.select("document_id", F.explode(F.array(F.struct((F.col("ordinal") * 10).alias("page_number"), head.alias("content")), F.struct((F.col("ordinal") * 10 + 1).alias("page_number"), F.col("content").alias("content")))).alias("p")).select("document_id", "p.*")
    return parsers.items(pages).select("document_id", "ordinal", "file_number", "title", (F.length("content") - F.instr("content", "]") - 1).cast("long").alias("length"), "start_page")


@query(f"""
with c as (select *, {", ".join(f"{_BARE_SQL(x)} as {x}_" for x in ("ayes", "noes", "absent", "excused"))} from {C})
select item_id, cast(row_number() over (partition by item_id order by sequence, id) as int) as sequence, right({_PLAIN_SQL("action")}, 1200) as action, array_to_string(ayes_, '|') as ayes, array_to_string(noes_, '|') as noes,
  array_to_string(absent_, '|') as absent, array_to_string(excused_, '|') as excused from c""")
def x02_roll_calls_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Roll calls written as the text of their items, with counts before, after and without names, come out again."""
    c = _calls(spark, sf)
    names = {x: _BARE(F.col(x)) for x in ("ayes", "noes", "absent", "excused")}
    count = lambda x: F.size(names[x]).cast("string")
    lines = (
        _PLAIN(F.col("action")), F.concat(F.lit("Ayes: "), count("ayes"), F.lit(" - "), F.array_join(names["ayes"], ",\n")), F.concat(F.lit("Noes: "), F.array_join(names["noes"], ", "), F.lit(" - "), count("noes")),
        F.concat(F.lit("Absent: "), count("absent"), F.when(F.size(names["absent"]) > 0, F.concat(F.lit("\nPage 7\n"), F.array_join(names["absent"], ", "))).otherwise("")), F.concat(F.lit("Excused: "), count("excused"), F.lit(" – "), F.array_join(names["excused"], ", ")),
    )
    written = c.select("item_id", "sequence", "id", F.concat_ws("\n", *lines).alias("l")).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("sequence", "id", "l"))).alias("all"))
    found = parsers.roll_calls(written.select("item_id", F.array_join(F.transform("all", lambda x: x["l"]), "\n").alias("content")), ["item_id"])
    return found.select("item_id", "sequence", "action", *[F.array_join(x, "|").alias(x) for x in names])


@query(f"""
with n as (select *, {_SQUEEZE("speaker")} as s, {_SQUEEZE("content")} as c from {N} where speaker is not null and content is not null)
select document_id, cast(row_number() over (partition by document_id order by page_number, ordinal, id) as int) as ordinal, page_number, s as speaker, c as content from n
where c <> '' and regexp_matches(s, '^[\\p{{L}}][\\p{{L}} .,''’()-]{{1,79}}$') and len(string_split(s, ' ')) <= 8 and not regexp_matches(s, '(?i)^(Page|Printed|Board)')""")
def x05_comments_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Comments written as pages, in two lines each, come out again, in order, with their speakers."""
    n = once(spark, sf, "public_comments").where("speaker is not null and content is not null").select("document_id", "page_number", "ordinal", "id", text.squeeze(F.col("speaker")).alias("s"), text.squeeze(F.col("content")).alias("c"))
    n = n.where((F.col("c") != "") & F.col("s").rlike(r"^[\p{L}][\p{L} .,'’()-]{1,79}$") & (F.size(F.split("s", " ")) <= 8) & ~F.col("s").rlike("(?i)^(Page|Printed|Board)"))
    both = F.concat("s", F.lit("; "), F.col("c"))
    pages = n.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("ordinal", "id", both.alias("l")))).alias("all"))
    pages = pages.select("document_id", "page_number", F.concat(F.lit("Call to order; x\nPublic Comment\n"), F.array_join(F.transform("all", lambda x: x["l"]), "\nPrinted at noon\n"), F.lit("\nADJOURNMENT\nNobody; after it")).alias("content"))
    return parsers.comments(pages)


@query(f"""
with e as (select id, title, {_GRAMS("title")} as g from {I} where title is not null), q as (select {_GRAMS("'hearing on overtime costs'")} as h)
select id as item_id, round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 6) as sim from e, q""")
def fz01_trigram(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "legislative_items", "title").where("title is not null").select(F.col("id").alias("item_id"), F.round(fuzzy.similarity(F.col("title"), F.lit("hearing on overtime costs")), 6).alias("sim"))


@query(f"""
with v as (select distinct w from (select unnest(regexp_split_to_array(lower(title), '[^a-z]+')) as w from {I}) where length(w) between 4 and 24),
q as (select unnest(['overtmie', 'libary', 'hearng', 'agreemnt', 'xqzzt', 'grant']) as q)
select q as word, v.w as correction, cast(damerau_levenshtein(q, v.w) as int) as distance from q join v on substring(q, 1, 1) = substring(v.w, 1, 1) and abs(length(q) - length(v.w)) <= 1 and damerau_levenshtein(q, v.w) <= 1
qualify row_number() over (partition by q order by damerau_levenshtein(q, v.w), v.w) = 1""")
def fz03_spell(spark: SparkSession, sf: str) -> DataFrame:
    q = spark.createDataFrame([(w,) for w in ("overtmie", "libary", "hearng", "agreemnt", "xqzzt", "grant")], "word string")
    return fuzzy.corrections(q, fuzzy.vocabulary(once(spark, sf, "legislative_items", "title"), "title"))


@query("""
with q as (select cast(embedding as double[]) as q from embeddings where vec_id = 0), e as (select vec_id, cast(embedding as double[]) as v from embeddings)
select vec_id, round(list_cosine_similarity(v, q), 6) as score from e, q order by list_cosine_similarity(v, q) desc, vec_id limit 20""")
def v01_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    return vectors.nearest(e, "vec_id", "embedding", list(q), 20).select("vec_id", F.round("score", 6).alias("score"))


@query("""
with q as (select cast(embedding as double[]) as q from embeddings where vec_id = 1), e as (select vec_id, cast(embedding as double[]) as v, 1.0 / (1 + vec_id % 17) as lexical from embeddings),
s as (select vec_id, lexical, case when vec_id % 4 = 0 then null else list_cosine_similarity(v, q) end as c from e, q)
select vec_id, round(0.65 * lexical / (select max(lexical) from s) + 0.35 * coalesce((c + 1) / 2, 0), 6) as score from s""")
def v02_hybrid_rerank(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 1").select("embedding").first()[0]])
    rows = e.select("vec_id", (1.0 / (1 + F.col("vec_id") % 17)).alias("lexical"), F.when(F.col("vec_id") % 4 != 0, vectors.cosine(F.col("embedding"), q)).alias("cosine"))
    return vectors.hybrid(rows).select("vec_id", F.round("score", 6).alias("score"))


@query("""
with l as (select vec_id as key, label % 3 + 1 as list_no, vec_id % 23 as score from embeddings order by label % 3 + 1, vec_id % 23 desc, vec_id limit 50),
q as (select cast(embedding as double[]) as q from embeddings where vec_id = 1),
s as (select vec_id as key, round(list_cosine_similarity(cast(embedding as double[]), q), 6) as cosine from embeddings, q order by 2 desc, 1 limit 50),
a as (select *, 1.0 / (60 + row_number() over (order by list_no, score desc, key)) + case when list_no = 1 then 0.008 else 0 end as f from l),
b as (select key, 0.8 / (60 + row_number() over (order by cosine desc, key)) as g from s)
select coalesce(a.key, b.key) as key, round(coalesce(f, 0.008) + coalesce(g, 0), 9) as fusion from a full join b on a.key = b.key order by coalesce(f, 0.008) + coalesce(g, 0) desc, 1 limit 20""")
def v06_rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Both candidate lists are top rows over the whole table."""
    e = table(spark, sf, "embeddings")
    n = search.budget(25)
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 1").select("embedding").first()[0]])
    lex = e.select(F.col("vec_id").alias("key"), (F.col("label") % 3 + 1).alias("list_no"), (F.col("vec_id") % 23).alias("score")).orderBy("list_no", F.desc("score"), "key").limit(n)
    sem = e.select(F.col("vec_id").alias("key"), F.round(vectors.cosine(F.col("embedding"), q), 6).alias("cosine")).orderBy(F.desc("cosine"), "key").limit(n)
    return vectors.fuse(lex, sem, F.col("list_no") == 1, 20).select("key", F.round("fusion", 9).alias("fusion"))


@query(f"""
with o as (select document_id, page_number, max(coalesce(content, '')) as content from {P} group by all)
select document_id, sha256(string_agg(cast(page_number as varchar) || chr(10) || content, chr(12) order by page_number)) as content_sha256, count(*) as page_count from o group by document_id""")
def d13_document_hash(spark: SparkSession, sf: str) -> DataFrame:
    return versions.document_hashes(table(spark, sf, "pages"))


def _edits(spark: SparkSession, sf: str, version: int) -> DataFrame:
    """Pages as of a version: each version upper-cases, drops or adds other pages."""
    p = table(spark, sf, "pages").groupBy("document_id", "page_number").agg(F.max(F.coalesce("content", F.lit(""))).alias("content"))
    if version == 3:
        return p
    text_ = F.when((F.col("document_id") + F.col("page_number")) % 5 == version, F.upper("content")).otherwise(F.col("content"))
    return p.where((F.col("document_id") * 7 + F.col("page_number")) % 11 != version).withColumn("content", text_)


@query(f"""
with o as (select document_id, page_number, max(coalesce(content, '')) as content from {P} group by all),
a as (select document_id, page_number, case when (document_id + page_number) % 5 = 1 then upper(content) else content end as c from o where (document_id * 7 + page_number) % 11 <> 1)
select coalesce(a.document_id, o.document_id) as document_id, coalesce(a.page_number, o.page_number) as page_number, case when a.document_id is null then 'added' when o.document_id is null then 'removed' else 'modified' end as change
from a full join o on a.document_id = o.document_id and a.page_number = o.page_number where a.c is distinct from o.content""")
def d16_version_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The first of three versions, rebuilt from sparse archives through the second, against the current pages."""
    v1, v2, v3 = (_edits(spark, sf, v) for v in (1, 2, 3))
    archives = versions.archive(v1, v2).withColumn("version_number", F.lit(1)).unionByName(versions.archive(v2, v3).withColumn("version_number", F.lit(2)))
    known = v3.select("document_id").distinct().withColumn("version_number", F.lit(1))
    return versions.diff(versions.reconstructed(v3, archives, known).drop("version_number"), v3)


@query(f"""
with o as (select document_id, page_number, max(coalesce(content, '')) as content from {P} group by all),
h as (select document_id, sha256(string_agg(cast(page_number as varchar) || chr(10) || content, chr(12) order by page_number)) as content_sha256, count(*) as page_count from o group by document_id),
known as (select document_id, 2 as version_number, case when document_id % 2 = 0 then content_sha256 else 'x' end as content_sha256 from h where document_id % 3 <> 0)
select h.document_id, cast(coalesce(k.version_number, 0) + 1 as int) as version_number, h.content_sha256, h.page_count, case when k.document_id is null then 'create' else 'update' end as change_type
from h left join known k on k.document_id = h.document_id where k.document_id is null or k.content_sha256 <> h.content_sha256""")
def d14_version_append(spark: SparkSession, sf: str) -> DataFrame:
    h = versions.document_hashes(table(spark, sf, "pages"))
    known = h.where("document_id % 3 <> 0").select("document_id", F.lit(2).alias("version_number"), F.when(F.col("document_id") % 2 == 0, F.col("content_sha256")).otherwise("x").alias("content_sha256"))
    return versions.append_versions(known, h)


@query(f"""
select i.document_id, i.start_page as page_number, cast(i.id as varchar) as entity_id, i.file_number as value_text, cast(instr(p.content, i.file_number) - 1 as int) as start_offset, left(i.content, 1000) as quote, cast(0.96 as decimal(4,3)) as confidence
from {I} i join {P} p on p.document_id = i.document_id and p.page_number = i.start_page where i.file_number is not null""")
def d12_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return versions.evidence(_items(spark, sf), once(spark, sf, "pages"))


@query(f"""
with p as (
  select id as roll_call_id, item_id, sequence, 'aye' as position, unnest(ayes) as recorded_name from {C} union select id, item_id, sequence, 'no', unnest(noes) from {C}
  union select id, item_id, sequence, 'absent', unnest(absent) from {C} union select id, item_id, sequence, 'excused', unnest(excused) from {C})
select * from p""")
def d09_positions(spark: SparkSession, sf: str) -> DataFrame:
    return votes.positions(_calls(spark, sf)).select("roll_call_id", "item_id", "sequence", "position", "recorded_name")


def _reconciled(spark: SparkSession, sf: str) -> DataFrame:
    dated = once(spark, sf, "legislative_items", "document_id", "file_number").withColumnRenamed("id", "item_id").join(once(spark, sf, "meeting_documents", "meeting_date").withColumnRenamed("id", "document_id"), "document_id").select("item_id", "meeting_date", "file_number")
    return votes.reconciled(votes.positions(_calls(spark, sf)), dated, table(spark, sf, "supervisors"))


_K = lambda x: f"regexp_replace(lower(strip_accents({x})), '[^a-z0-9]', '', 'g')"
_RECONCILED = f"""
with c as {C}, p as (
  select id as roll_call_id, item_id, sequence, is_final, 'aye' as position, unnest(ayes) as recorded_name from c union select id, item_id, sequence, is_final, 'no', unnest(noes) from c
  union select id, item_id, sequence, is_final, 'absent', unnest(absent) from c union select id, item_id, sequence, is_final, 'excused', unnest(excused) from c),
q as (select p.*, d.meeting_date, i.file_number, {_K("recorded_name")} as k from p left join {I} i on i.id = p.item_id left join {D} d on d.id = i.document_id),
t as (select k, meeting_date, arg_max(s.id, (coalesce(term_start, date '1000-01-01'), -s.id)) as by_term from (select distinct k, meeting_date from q) n join supervisors s on {_K("s.family_name")} = n.k
  and (term_start is null or n.meeting_date >= term_start) and (term_end is null or n.meeting_date <= term_end) group by all),
al as (
  select {_K("alias")} as k, arg_max(id, (c, -id)) as by_alias, max(c) as conf from (
    select id, display_name as alias, 1.0 as c from supervisors union all select id, family_name, 0.9 from supervisors where family_name in (select family_name from supervisors group by 1 having count(*) = 1) union all select id, slug, 0.8 from supervisors) group by 1),
r as (select q.*, coalesce(t.by_term, al.by_alias) as supervisor_id, case when t.by_term is not null then 0.98 when al.by_alias is not null then al.conf else 0.5 end as confidence
  from q left join t on t.k = q.k and t.meeting_date = q.meeting_date left join al on al.k = q.k)
"""


@query(_RECONCILED + "select roll_call_id, position, recorded_name, supervisor_id, cast(confidence as decimal(4,3)) as confidence from r")
def d09_reconciled(spark: SparkSession, sf: str) -> DataFrame:
    return _reconciled(spark, sf).select("roll_call_id", "position", "recorded_name", "supervisor_id", "confidence")


_MEMBER_VOTES = _RECONCILED + """
, v as (select * from r where supervisor_id = 12 and is_final and year(meeting_date) between 1996 and 2100 qualify row_number() over (partition by coalesce(file_number, '#' || cast(roll_call_id as varchar) || ' ' || position) order by meeting_date desc, sequence desc, roll_call_id desc) = 1)
, w as (select *, count(*) over () as total, row_number() over (order by meeting_date desc, file_number desc nulls last, roll_call_id desc) as rank from v)"""


def _member(spark: SparkSession, sf: str) -> DataFrame:
    i, d, r = _search_tables(spark, sf)
    return evidence.member_votes(r.dropDuplicates(["id"]), i, d, table(spark, sf, "supervisors"), "Anthony Hargreen")


@query(_MEMBER_VOTES + " select file_number, roll_call_id, meeting_date, position, total, rank from w where rank <= 100")
def a01_vote_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """A member's newest final vote for each file, the newest hundred, with the number of files."""
    return evidence.vote_aggregate(_member(spark, sf), final=True).select("file_number", "roll_call_id", "meeting_date", "position", "total", "rank")


@query(_RECONCILED + """
, v as (select * from r where supervisor_id = 12 and position = 'no' and year(meeting_date) between 2000 and 2020)
select file_number, roll_call_id, meeting_date, count(*) over () as total, row_number() over (order by meeting_date desc, file_number desc nulls last, roll_call_id desc) as rank from v qualify rank <= 20""")
def a01_votes_single(spark: SparkSession, sf: str) -> DataFrame:
    """A member's noes of some years, each roll call by itself, the newest twenty."""
    return evidence.vote_aggregate(_member(spark, sf), 2000, 2020, "no", by_file=False, limit=20).select("file_number", "roll_call_id", "meeting_date", "total", "rank")


@query(_MEMBER_VOTES + """
select *, (select count(*) filter (where position = 'aye') from r where supervisor_id = 12) as all_aye, (select count(*) filter (where position = 'no') from r where supervisor_id = 12) as all_no, (select count(*) filter (where position = 'absent') from r where supervisor_id = 12) as all_absent,
  (select count(*) filter (where position = 'excused') from r where supervisor_id = 12) as all_excused
from (select count(*) filter (where position = 'aye') as aye, count(*) filter (where position = 'no') as no, count(*) filter (where position = 'absent') as absent, count(*) filter (where position = 'excused') as excused from w where rank <= 100)""")
def a01_vote_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Positions over the rows returned, and over all of the member's."""
    own = cut(_member(spark, sf))
    return evidence.counts(evidence.vote_aggregate(own, final=True), own)


@query(_MEMBER_VOTES + f"""
, f as (select item_id, flatten(list(housing_units)) as units, flatten(list(addresses)) as addresses from (select distinct * from extracted_facts) group by item_id),
g as (select w.*, case when len(units) > 0 then list_max(units) end as most, addresses from w left join f using (item_id) where rank <= 100)
select count(most) as known, count(*) - count(most) as unknown, cast(coalesce(sum(most), 0) as bigint) as units, coalesce((select string_agg(a, '|' order by a) from (select distinct unnest(addresses) as a from g)), '') as addresses from g""")
def a02_housing(spark: SparkSession, sf: str) -> DataFrame:
    """Housing over the files of the vote aggregate: known and unknown, the sum of each one's greatest, addresses."""
    page = evidence.vote_aggregate(_member(spark, sf), final=True)
    return evidence.housing_aggregate(page, table(spark, sf, "extracted_facts").dropDuplicates(["fact_id"])).withColumn("addresses", F.array_join("addresses", "|"))


@query()
def s10_evidence_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """What stands for an answer to a question about a member's votes."""
    i, d, r = _search_tables(spark, sf)
    supervisors = table(spark, sf, "supervisors")
    intent = interpret("How did Hargreen vote on tenant relocation?", ["Hargreen", "Nunarte"])
    return evidence.bundle(intent, i, table(spark, sf, "pages"), table(spark, sf, "public_comments"), d, r.dropDuplicates(["id"]), supervisors, table(spark, sf, "extracted_facts").dropDuplicates(["fact_id"]))


@query(f"""
with c as (select item_id, id, sequence, is_final, list_contains(list_transform(ayes, lambda x: {_K("x")}), 'hargreen') as fits from {C}),
s as (select item_id, arg_min(id, (case when is_final and fits then 0 when is_final then 1 else 2 end, sequence, id)) as shown, count(*) as calls, count(*) filter (where fits) as own from c group by 1)
select item_id, shown, case when own > 0 then own else least(calls, 2) end as relevant from s""")
def s06_shown_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Of each item the roll call to show for a voter's ayes, and how many bear on them."""
    calls = evidence.nested_calls(_calls(spark, sf))
    shown = evidence.shown_call(F.col("calls"), "Hargreen", "aye")
    return calls.select("item_id", shown["id"].alias("shown"), F.size(evidence.relevant_calls(F.col("calls"), "Hargreen", "aye")).cast("long").alias("relevant"))


@query(f"""
select 'page' as part, cast(id as varchar) as id, page_number as position from {P} where document_id = 12 and page_number between 1 and 3
union all select 'item', cast(id as varchar), ordinal from {I} where document_id = 12 and end_page >= 1 and start_page <= 3 union all select 'document', '12', 0""")
def a07_document_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """One document's first three pages with the items that meet them."""
    i, d, r = _search_tables(spark, sf)
    p = table(spark, sf, "pages")
    spans = versions.evidence(once(spark, sf, "legislative_items"), once(spark, sf, "pages")).select(F.lit("item").alias("entity_type"), "entity_id", "confidence", F.lit("1").alias("parser_version"))
    known = versions.document_hashes(p).select("document_id", F.lit(1).alias("version_number"), "content_sha256")
    return evidence.document_evidence(12, d, p, i, r, spans, known, 1, 3).select("part", "id", "position")


@query(_RECONCILED + f"""
select r.roll_call_id, r.position, row_number() over (order by r.meeting_date desc, i.ordinal desc, r.sequence desc, r.roll_call_id desc, r.position) as rank from r join {I} i on i.id = r.item_id where r.supervisor_id = 12 qualify rank <= 250""")
def a05_newest_votes(spark: SparkSession, sf: str) -> DataFrame:
    """A member's newest 250 recorded positions."""
    return evidence.member_profile(_member(spark, sf), votes.aliases(table(spark, sf, "supervisors")))[1].select("roll_call_id", "position", "rank")


@query(_RECONCILED + "select s.id as supervisor_id, s.display_name, min(meeting_date) as first_vote, max(meeting_date) as last_vote, count(r.roll_call_id) as positions from supervisors s left join r on r.supervisor_id = s.id group by all")
def a03_member_list(spark: SparkSession, sf: str) -> DataFrame:
    return votes.member_list(table(spark, sf, "supervisors"), _reconciled(spark, sf)).select("supervisor_id", "display_name", "first_vote", "last_vote", "positions")


@query(_RECONCILED + "select supervisor_id, position, count(*) as n, min(meeting_date) as first_vote, max(meeting_date) as last_vote from r where supervisor_id is not null group by all")
def a05_member_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return _reconciled(spark, sf).where("supervisor_id is not null").groupBy("supervisor_id", "position").agg(F.count("*").alias("n"), F.min("meeting_date").alias("first_vote"), F.max("meeting_date").alias("last_vote"))


@query("""
select supervisor_id, alias, normalized_alias, confidence from (
  select id as supervisor_id, alias, regexp_replace(lower(strip_accents(alias)), '[^a-z0-9]', '', 'g') as normalized_alias, c as confidence, row_number() over (partition by regexp_replace(lower(strip_accents(alias)), '[^a-z0-9]', '', 'g') order by c desc, id, alias desc) as k from (
    select id, display_name as alias, 1.0::double as c from supervisors union all select id, family_name, 0.9::double from supervisors where family_name in (select family_name from supervisors group by 1 having count(*) = 1) union all select id, slug, 0.8::double from supervisors)) where k = 1""")
def a04_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return votes.aliases(table(spark, sf, "supervisors"))


@query(f"select id, row_number() over (order by meeting_date desc, kind <> 'agenda', id desc) as rank from {D} qualify rank <= 100")
def a06_document_list(spark: SparkSession, sf: str) -> DataFrame:
    order = (F.desc("meeting_date"), F.asc("late"), F.desc("id"))
    d = once(spark, sf, "meeting_documents", "meeting_date", "kind").withColumn("late", F.when(F.col("kind") == "agenda", 0).otherwise(1))
    return d.orderBy(*order).limit(100).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("id", "rank")


@query(f"""
with c as (select item_id, string_agg(cast(sequence as varchar) || ':' || action_type, '|' order by sequence, action_type) as calls, count(*) as n from {C} group by item_id)
select cast(i.id as varchar) as id, coalesce(c.calls, '') as calls, coalesce(n, 0) as n from {I} i left join c on c.item_id = i.id""")
def ag08_nested_roll_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Roll calls of each item as an ordered array, empty where there is none."""
    c = _calls(spark, sf).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("sequence", "action_type"))).alias("calls"))
    i = once(spark, sf, "legislative_items", "file_number")
    joined = i.join(c, i["id"] == c["item_id"], "left").withColumn("calls", F.coalesce("calls", F.array().cast(c.schema["calls"].dataType)))
    return joined.select(F.col("id").cast("string").alias("id"), F.array_join(F.transform("calls", lambda x: F.concat_ws(":", x["sequence"].cast("string"), x["action_type"])), "|").alias("calls"), F.size("calls").cast("long").alias("n"))


_HASHED = f"""
with o as (select document_id, page_number, max(coalesce(content, '')) as content from {P} group by all),
h as (select document_id, sha256(string_agg(cast(page_number as varchar) || chr(10) || content, chr(12) order by page_number)) as content_sha256, count(*) as page_count from o group by document_id)
"""


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of each document: an older one of which little is known, and the current."""
    h = versions.document_hashes(table(spark, sf, "pages"))
    return h.select("document_id", F.explode(F.array(F.struct(F.lit(1).alias("version_number"), F.lit("older").alias("content_sha256")), F.struct(F.lit(2).alias("version_number"), F.col("content_sha256").alias("content_sha256")))).alias("v")).select("document_id", "v.*")


@query(_HASHED + f"""
select cast(d.id as varchar) as id, d.kind, cast(d.page_count as int) as "pageCount", case when h.document_id is not null then 2 end as version, h.content_sha256 as "contentSha256" from {D} d left join h on h.document_id = d.id where d.id > 20 order by d.id limit 50""")
def d20_document_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return feed.document_snapshot(feed.page(_documents(spark, sf), "id", 20, 50), _versions(spark, sf)).select("id", "kind", "pageCount", "version", "contentSha256")


@query("""
with a as (select supervisor_id, alias, confidence from (
  select id as supervisor_id, alias, c as confidence, row_number() over (partition by regexp_replace(lower(strip_accents(alias)), '[^a-z0-9]', '', 'g') order by c desc, id, alias desc) as k from (
    select id, display_name as alias, 1.0::double as c from supervisors union all select id, family_name, 0.9::double from supervisors where family_name in (select family_name from supervisors group by 1 having count(*) = 1) union all select id, slug, 0.8::double from supervisors)) where k = 1),
g as (select supervisor_id, string_agg(alias, '|' order by length(alias) desc, alias) as aliases from a group by 1)
select cast(id as varchar) as id, slug, family_name as "familyName", strftime(term_start, '%Y-%m-%d') as "termStart", active, coalesce(aliases, '') as aliases from supervisors left join g on supervisor_id = id""")
def d20_supervisor_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supervisors")
    return identifiers.supervisor_snapshot(s, votes.aliases(s)).select("id", "slug", "familyName", "termStart", "active", F.array_join(F.transform("aliases", lambda x: x["alias"]), "|").alias("aliases"))


@query(_RECONCILED + f"""
select r.roll_call_id || ':' || position || ':' || recorded_name as id, s.slug as "supervisorSlug", position, c.action, r.file_number as "fileNumber", strftime(meeting_date, '%Y-%m-%d') as "meetingDate", i.start_page as page
from r join c on c.id = r.roll_call_id join {I} i on i.id = r.item_id left join supervisors s on s.id = r.supervisor_id""")
def d20_position_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    i, _, r = _search_tables(spark, sf)
    p = _reconciled(spark, sf).drop("file_number")
    return identifiers.position_snapshot(p, table(spark, sf, "supervisors"), i, r).select("id", "supervisorSlug", "position", "action", "fileNumber", "meetingDate", "page")


@query(f"""
select file_number as "fileNumber", cast(max(legislative_file_id) as varchar) as "fileId", arg_max(coalesce(i.title, chr(0)), (m.meeting_date, i.ordinal, i.id)) as title, strftime(min(meeting_date), '%Y-%m-%d') as "firstSeenDate", strftime(max(meeting_date), '%Y-%m-%d') as "lastSeenDate"
from {I} i join {D} m on m.id = i.document_id where file_number is not null group by 1""")
def d20_file_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return identifiers.file_snapshot(table(spark, sf, "legislative_items"), table(spark, sf, "meeting_documents")).withColumn("title", F.coalesce("title", F.lit("\0")))


@query(f"""
select id as document_id, 'event-id' as scheme, cast(event_id as varchar) as value from {D} where event_id is not null union select id, 'event-guid', event_guid from {D} where event_guid is not null union select id, 'official-url', official_url from {D} where official_url is not null""")
def d11_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return identifiers.identifiers(table(spark, sf, "meeting_documents"))


@query(f"""
select event_id, min(event_guid) as event_guid, min(meeting_date) as event_date, max(official_url) filter (where kind = 'agenda') as agenda_url, max(official_url) filter (where kind = 'minutes') as minutes_url from {D} where event_id is not null group by 1""")
def d11_events(spark: SparkSession, sf: str) -> DataFrame:
    return identifiers.events(table(spark, sf, "meeting_documents"))


@query(_HASHED + """
select document_id, v as version_number, case when v = 1 then 'reader' end as parser_name from h, (values (1), (2)) t(v)""")
def d18_version_list(spark: SparkSession, sf: str) -> DataFrame:
    """Versions with the parser that made them, where it is known."""
    runs = spark.createDataFrame([(7, "reader", "1"), (8, "other", "1")], "id long, parser_name string, parser_version string")
    v = _versions(spark, sf).withColumn("parser_run_id", F.when(F.col("version_number") == 1, 7).otherwise(99).cast("long"))
    return identifiers.version_list(v, runs).select("document_id", "version_number", "parser_name")


@query(f"""
select 'document' as entity_type, cast(id as varchar) as entity_key, 'create' as change_type, cast(page_count as varchar) as version from {D} where kind <> 'agenda'""")
def d22_seeded_changes(spark: SparkSession, sf: str) -> DataFrame:
    """First changes of all documents that the log lacks; it knows the agendas."""
    d = table(spark, sf, "meeting_documents")
    log = d.where("kind = 'agenda'").select(F.lit("document").alias("entity_type"), F.col("id").cast("string").alias("entity_key"))
    return jobs.seeded(log, d, "document", "id", "page_count")


@query(f"""
with d as {D}, x as (select * from d where page_count > 0),
m as (
  select j.id as k, 3 as r, x.indexed_at, x.id from d j join x on x.official_url = j.official_url || case when j.id % 2 = 0 then '?' else '' end
  union all select j.id, 2, x.indexed_at, x.id from d j join x on j.event_id = x.event_id and j.kind = x.kind where j.event_id is not null
  union all select j.id, 1, x.indexed_at, x.id from d j join x on j.meeting_date = x.meeting_date and j.kind = x.kind where j.event_id is null)
select cast(k as varchar) as source_key, id as document_id from m qualify row_number() over (partition by k order by r desc, indexed_at desc nulls last, id desc) = 1""")
def jn19_job_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Of each job its document by URL (half of them have another one), else by event or date, and kind."""
    d = _documents(spark, sf)
    url = F.concat("official_url", F.when(F.col("id") % 2 == 0, "?").otherwise(""))
    return jobs.matched(d.select(F.col("id").cast("string").alias("source_key"), url.alias("official_url"), "event_id", "kind", "meeting_date"), d)


@query(f"""
with d as {D}, calendar as (select distinct meeting_date, kind from d where event_id is not null)
select meeting_date, kind, 'calendar' as origin from calendar union all
select distinct meeting_date, kind, 'archive' from d where (meeting_date, kind) not in (select meeting_date, kind from calendar)""")
def jn23_calendar_over_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Meetings that the calendar names, and those of the archive that it lacks."""
    d = table(spark, sf, "meeting_documents")
    side = lambda rows, name: rows.select("meeting_date", "kind").distinct().withColumn("origin", F.lit(name))
    return jobs.preferred(side(d.where("event_id is not null"), "calendar"), side(d, "archive"), ["meeting_date", "kind"])


@query(f"""
with s as (select slug, family_name, display_name, active, term_start, term_end from supervisors),
n as (select distinct slug, active, term_start, term_end, lower(x) as k from (select *, unnest([family_name, display_name]) as x from s)),
c as (select id, 'The vote of ' || display_name || ' and ' || family_name || 's, then ' || family_name || ', too' as t, display_name, family_name, (select max(meeting_date) from {D}) as day from supervisors),
f as (select id, 1 as "at", display_name as name, day from c union all select id, 2, family_name, day from c)
select id, "at", name, arg_max(slug, (case when term_start is not null and term_end is not null then case when day between term_start and term_end then 3 else 0 end when active and year(day) >= 2024 then 2 else 1 end, slug)) as slug
from f join n on n.k = lower(f.name) group by id, "at", name""")
def x17_name_links(spark: SparkSession, sf: str) -> DataFrame:
    """The names in a sentence about each member: whole words only, the likeliest member on the day."""
    s = table(spark, sf, "supervisors")
    day = table(spark, sf, "meeting_documents").agg(F.max("meeting_date").alias("day"))
    texts = s.select("id", F.concat(F.lit("The vote of "), "display_name", F.lit(" and "), "family_name", F.lit("s, then "), "family_name", F.lit(", too")).alias("t")).crossJoin(F.broadcast(day))  # one row
    none = spark.createDataFrame([], "supervisor_id long, alias string")
    return linking.linked(texts, "id", "t", "day", linking.name_links(s, none), 2026)


@query(_RECONCILED + f"""
select (select count(*) from {D}) as documents, (select count(*) from {D} where page_count > 0) as indexed, (select count(*) from {D} where page_count = 0) as catalog_only,
  (select count(*) from {D} d where page_count > 0 and not exists (select 1 from pages p where p.document_id = d.id)) as without_pages, (select count(*) from {D} d where page_count > 0 and d.kind = 'agenda') as without_versions,
  (select count(*) from {I}) as items, (select count(*) from {I} i where not exists (select 1 from roll_calls r where r.item_id = i.id)) as without_roll_calls,
  (select count(*) from r) as positions, (select count(*) from r where supervisor_id is null) as unresolved, (select count(*) from r where confidence is not null) as spans, (select count(*) from r where confidence < 0.8) as low_confidence,
  (select count(distinct file_number) from {I}) as files, (select count(distinct file_number) from {I} where legislative_file_id is not null) as matched_files""")
def d21_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Thirteen counts over the tables in one row, each table read once and each join an anti join of its own."""
    d, i = once(spark, sf, "meeting_documents", "page_count", "kind"), once(spark, sf, "legislative_items", "file_number", "legislative_file_id")
    some = d.where("page_count > 0")
    p, r = table(spark, sf, "pages").select("document_id"), table(spark, sf, "roll_calls").select("item_id")
    known = d.where("kind <> 'agenda'").select(F.col("id").alias("document_id"))  # documents that have a version
    q = _reconciled(spark, sf)
    one = d.agg(F.count("*").alias("documents"), F.count_if(F.col("page_count") > 0).alias("indexed"), F.count_if(F.col("page_count") == 0).alias("catalog_only"))
    for row in (
        some.join(p, some["id"] == p["document_id"], "left_anti").agg(F.count("*").alias("without_pages")),
        some.join(known, some["id"] == known["document_id"], "left_anti").agg(F.count("*").alias("without_versions")),
        i.agg(F.count("*").alias("items"), F.countDistinct("file_number").alias("files"), F.countDistinct(F.when(F.col("legislative_file_id").isNotNull(), F.col("file_number"))).alias("matched_files")),
        i.join(r, i["id"] == r["item_id"], "left_anti").agg(F.count("*").alias("without_roll_calls")),
        q.agg(F.count("*").alias("positions"), F.count_if(F.col("supervisor_id").isNull()).alias("unresolved"), F.count("confidence").alias("spans"), F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("low_confidence")),
    ):
        one = one.crossJoin(F.broadcast(row))  # one row each
    return one


#: Below this a span is of low confidence.
LOW_CONFIDENCE = 0.8


@query(f"""
select kind, source_format, count(*) as runs, max(indexed_at) as last_finished, row_number() over (order by max(indexed_at) desc nulls last, kind, source_format) as rank from {D} group by kind, source_format""")
def ag12_parser_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Groups by their last date, those without one at the end."""
    g = table(spark, sf, "meeting_documents").dropDuplicates(["id"]).groupBy("kind", "source_format").agg(F.count("*").alias("runs"), F.max("indexed_at").alias("last_finished"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("last_finished"), "kind", "source_format")))


@query(_RECONCILED + "select recorded_name, count(*) as n from r where supervisor_id is null group by 1 order by n desc, recorded_name limit 20")
def ag13_unresolved_names(spark: SparkSession, sf: str) -> DataFrame:
    return _reconciled(spark, sf).where("supervisor_id is null").groupBy("recorded_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "recorded_name").limit(20)


@query(f"""
with p as (select id as document_id, unnest(string_split(content, chr(10) || chr(10))) as s, unnest(range(1, len(string_split(content, chr(10) || chr(10))) + 1)) as n from {P} where content is not null),
c as (select document_id, n as page_number, regexp_replace(trim(regexp_replace(s, '[ \\t]+(\\n)', '\\1', 'g')), '^\\s+|\\s+$', '', 'g') as c from p)
select document_id, page_number, md5(c) as content from c where c <> ''""")
def src01_page_split(spark: SparkSession, sf: str) -> DataFrame:
    """Blank lines stand for page ends here, as the texts have no form feeds; pages number before empty ones go."""
    p = once(spark, sf, "pages", "content").where("content is not null").select(F.col("id").alias("document_id"), F.replace("content", F.lit("\n\n"), F.lit("\f")).alias("content"))
    return records.split_pages(p, "document_id", "content").select("document_id", F.col("page_number").cast("long").alias("page_number"), F.md5("content").alias("content"))


@query(f"select id, cast(regexp_extract(local_path, '(\\d{{4}}-\\d{{2}}-\\d{{2}})_', 1) as date) as meeting_date, regexp_extract(local_path, '^(agenda|minutes)', 1) as kind from {D} where local_path is not null")
def src02_file_names(spark: SparkSession, sf: str) -> DataFrame:
    d = once(spark, sf, "meeting_documents", "local_path", "kind").where("local_path is not null")
    paths = d.select("id", F.concat(F.regexp_replace("local_path", r"_\d+\.\w+$", ""), F.lit("_"), F.col("kind"), F.lit(".pdf")).alias("path"))
    return paths.join(records.file_records(paths.select("path").distinct()), "path").select("id", "meeting_date", "kind")


@query("select doc_id, sha256(text) as sha256, text like '%PDF%' and starts_with(text, '%PDF') as is_pdf from documents where text is not null")
def src17_hash_verify(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("content"))
    return records.verified(d).select("doc_id", "sha256", "is_pdf")


@query(f"""
with s as (select document_id, matter, ordinal, id, concat_ws(' ', file_number, coalesce(title, '') || '.', left({_SQUEEZE("left(regexp_replace(coalesce(content, ''), '^\\s*\\d{6}\\s+\\[[\\s\\S]*?\\]\\s*', ''), 3000)")}, 3500)) as line from {I}),
w as (select document_id, matter, md5(string_agg(line, chr(10) order by ordinal, line)) as context from s where matter is not null group by 1, 2)
select i.id as item_id, w.context from {I} i left join w on w.document_id = i.document_id and w.matter = i.matter""")
def ag22_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Each item with the summaries of the items of its matter in its document; as a hash, for they are long."""
    return parsers.contexts(_items(spark, sf)).select(F.col("id").alias("item_id"), F.md5("context").alias("context"))


@query(f"""
select cast(d.id as varchar) as id, '/documents/' || d.id || '/' || strftime(meeting_date, '%Y-%m-%d') || '-' || kind as path, regexp_replace(title, '\\s+—\\s+', ': ', 'g') as title,
  case when length(trim(regexp_replace(title, '\\s+', ' ', 'g'))) > 24 then regexp_replace(left(trim(regexp_replace(title, '\\s+', ' ', 'g')), 24), '\\s+\\S*$', '') || '…' else trim(regexp_replace(title, '\\s+', ' ', 'g')) end as short from {D} d""")
def p04_urls_and_titles(spark: SparkSession, sf: str) -> DataFrame:
    d = once(spark, sf, "meeting_documents", "meeting_date", "kind", "title")
    return d.select(F.col("id").cast("string").alias("id"), text.document_path(F.col("id"), F.col("meeting_date"), F.col("kind")).alias("path"), text.plain_title(F.col("title")).alias("title"), text.shorten(F.col("title"), 24).alias("short"))


@query(f"""
select year, count(*) filter (where kind = 'agenda') as agendas, count(*) filter (where kind = 'minutes') as minutes, count(*) filter (where source_format = 'pdf') as pdf, count(*) filter (where source_format = 'html') as html from {D} group by year""")
def ag20_per_year(spark: SparkSession, sf: str) -> DataFrame:
    k, f = F.col("kind"), F.col("source_format")
    return once(spark, sf, "meeting_documents", "year", "kind", "source_format").groupBy("year").agg(F.count_if(k == "agenda").alias("agendas"), F.count_if(k == "minutes").alias("minutes"), F.count_if(f == "pdf").alias("pdf"), F.count_if(f == "html").alias("html"))


@query(f"""
select i.file_number, min(m.meeting_date) as first_seen, max(m.meeting_date) as last_seen, count(*) as items, arg_max(i.id, (m.meeting_date, i.ordinal, i.id)) as latest_item
from {I} i join {D} m on m.id = i.document_id where i.file_number is not null group by i.file_number""")
def d10_file_history(spark: SparkSession, sf: str) -> DataFrame:
    i, m = once(spark, sf, "legislative_items", "document_id", "ordinal", "file_number"), once(spark, sf, "meeting_documents", "meeting_date").withColumnRenamed("id", "document_id")
    return i.where("file_number is not null").join(m, "document_id").groupBy("file_number").agg(F.min("meeting_date").alias("first_seen"), F.max("meeting_date").alias("last_seen"), F.count("*").alias("items"), F.max_by("id", F.struct("meeting_date", "ordinal", "id")).alias("latest_item"))
