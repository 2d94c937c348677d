import datetime

import pytest
from pyspark.sql import functions as F

from minutebook.operators import feed, identifiers, jobs, merge, parsers, render, tables, versions
from minutebook.sources import records

MINUTES = """230001 [Street Lighting]
Ordinance on lighting.
PASSED ON FIRST READING by the following vote:
Ayes: 3 - Kim, Lee,
Page 4
Chan
Noes: 1 - Park
230002 [Old Pier - Proposed Lease]
Text.
Ayes: Kim, Lee - 2
Absent: none
PUBLIC COMMENT
Ann Bell; spoke on trees
and parks.
Speaker; spoke too
ADJOURNMENT
Not; a comment
"""


def calls_of(spark, *contents):
    df = spark.createDataFrame(list(enumerate(contents)), "id int, content string")
    return [(r.id, r.sequence, r.action, r.ayes, r.noes, r.absent, r.excused) for r in parsers.roll_calls(df, ["id"]).orderBy("id", "sequence").collect()]


def test_items():
    items = parsers.items_of([(1, MINUTES[: MINUTES.index("230002")]), (3, MINUTES[MINUTES.index("230002") :])])
    assert [(i["file_number"], i["title"], i["start_page"]) for i in items] == [("230001", "Street Lighting", 1), ("230002", "Old Pier - Proposed Lease", 3)]
    assert parsers.items_of([(1, None), (2, "")]) == []
    old = parsers.items_of([(1, "[Old Title]\nabout File 12-A.\n[Nothing here]\nx")])
    assert [(i["file_number"], i["title"]) for i in old] == [("12-A", "Old Title")]


def test_roll_calls(spark):
    got = calls_of(
        spark,
        "Motion to adopt\nFAILED by the vote:\nAyes: 3 - Kim, Lee,\nPage 4\nChan\nNoes: 1 - Park\nMoved on.\nADOPTED\nAyes: Supervisors Kim, Lee; - 2\nNoes: 0\nAbsent: none\nrest",
        "Ayes: 2\nKim, Lee, Chan\nlater",  # a count alone, more names than it says
        "Noes: Ann,\n Bell\n230001 [Next]\nNoes: 1 - X",  # no count: all lines to the next item
        "x\nAyes:\n2 - Kim,\nLee\nExcused: Al.\n",  # the count on the wrapped line
        None, "", "no votes", "Ayes: " + "A" * 100_000,
    )
    assert got[:2] == [
        (0, 1, "Motion to adopt FAILED by the vote:", ["Kim", "Lee", "Chan"], ["Park"], [], []),
        (0, 2, "Moved on. ADOPTED", ["Kim", "Lee"], [], [], []),
    ]
    assert got[2:6] == [(1, 1, "", ["Kim", "Lee"], [], [], []), (2, 1, "", [], ["Ann", "Bell"], [], []), (2, 2, "230001 [Next]", [], ["X"], [], []), (3, 1, "x", ["Kim", "Lee"], [], [], ["Al"])]
    assert len(got) == 7 and got[6][3] == ["A" * 100_000]


def test_comments(spark):
    rows = [
        (7, 1, "Intro; not a comment\nPUBLIC COMMENT\nno speaker yet\nAnn Bell; spoke on trees\nPage 4\nand parks."),
        (7, 2, "and goes on\n\nSpeaker; spoke too\nOne two three four five six seven eight nine; goes on\nJosé D’Arc; \nADJOURNMENT\nNot; a comment"),
        (7, 4, "Bo; nothing\nPUBLIC COMMENT CONTINUED\nBo; again"), (7, 5, None), (8, 1, ""), (None, 1, "PUBLIC COMMENT\nA B; c"),
    ]
    pages = spark.createDataFrame([*rows, rows[0]], "document_id long, page_number int, content string")
    got = [(r.document_id, r.ordinal, r.page_number, r.speaker, r.content) for r in parsers.comments(pages).orderBy("document_id", "ordinal").collect()]
    assert got == [
        (7, 1, 1, "Ann Bell", "spoke on trees and parks. and goes on"),
        (7, 2, 2, "Speaker", "spoke too One two three four five six seven eight nine; goes on"),
        (7, 3, 4, "Bo", "again"),
    ]
    assert parsers.comments(pages.limit(0)).count() == 0


def test_parsers_on_tables(spark):
    pages = spark.createDataFrame([(1, 7, 1, MINUTES, "x"), (1, 7, 1, MINUTES, "x"), (2, 8, 1, None, "y")], "id long, document_id long, page_number int, content string, title string")
    items = parsers.contexts(parsers.items(pages))
    assert items.count() == 2 and items.where(F.col("context").startswith("23000")).count() == 2
    assert parsers.roll_calls(items, ["document_id", "ordinal"]).count() == 2
    assert parsers.comments(pages).count() == 2 and parsers.items(pages.limit(0)).count() == 0
    text = spark.createDataFrame([("230001 [A\nB] first (Clerk of the Board) rest",), ("plain " * 2000,), (None,)], "c string")
    assert [len(r[0]) if r[0] else r[0] for r in text.select(parsers.summary(F.col("c"))).collect()] == [5, 2999, None]


def test_readers(spark):
    doc = spark.createDataFrame([(1, "one \n\f\f two\0 ")], "id int, text string")
    assert [tuple(r) for r in records.split_pages(doc, "id", "text").collect()] == [(1, 1, "one"), (1, 3, "two")]
    paths = spark.createDataFrame([("a/2011-02-03_77_ab-c_agenda.pdf",), ("bag020398_minutes.txt",), ("other.txt",)], "path string")
    assert [(str(r.meeting_date), r.kind, r.event_id) for r in records.file_records(paths).collect()] == [("1998-02-03", "minutes", None), ("2011-02-03", "agenda", 77)]
    assert records.text_of('<div id="content"><p>A&amp;B</p><div>in</div><script>x</script></div>out', least=1) == "A&B\n\nin"
    html = spark.createDataFrame([(2001, '<h2>Agendas</h2><li><a href="a.pdf">May 1, 2001</a></li><li><a href="b.htm">May 1, 2002</a></li><h2>Minutes</h2><li><a href="c.htm">June 5, 2001</a></li>')], "year int, page string")
    assert {(r.url, r.kind, r.source_format) for r in records.catalog_links(html, "year", "page").collect()} == {("a.pdf", "agenda", "pdf"), ("c.htm", "minutes", "html")}
    a = spark.createDataFrame([(1, 1, "long enough text here"), (1, 2, "x")], "document_id int, page_number int, content string")
    b = spark.createDataFrame([(1, 2, "scanned text of the page")], "document_id int, page_number int, content string")
    assert {(r.page_number, r.content[:7], r.method) for r in records.with_fallback(a, b).collect()} == {(1, "long en", "text+scan"), (2, "scanned", "text+scan")}


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "B", 1), (3, "c", 3), (None, None, 5)], "k int, v string, n int")
    assert {tuple(r) for r in merge.upsert(old, new, ["k"], {"n": F.greatest, "v": lambda a, b: F.coalesce(b, a)}).collect()} == {(1, "a", 1), (2, "B", 2), (3, "c", 3), (None, "n", 5)}
    assert {(r.k, r.created) for r in merge.changed(old, new, ["k"], ["v"]).collect()} == {(2, False), (3, True), (None, False)}
    assert merge.insert_new(old, new, ["k"]).count() == 4
    assert merge.upsert(old.limit(0), new, ["k"]).count() == 3 and merge.upsert(old, new.limit(0), ["k"]).count() == 3


def test_tables_have_whole_states(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read(spark, path) is None
    for n in (3, 5, 4):
        before = tables.read(spark, path)
        tables.publish(spark.range(n), path)
        assert tables.read(spark, path).count() == n
        assert before is None or before.count() > 0  # a reader of the state before still has its files
    rows = lambda *x: spark.createDataFrame(list(x), "id long, at int")
    path = str(tmp_path / "u")
    for batch in (rows((1, 1), (2, 1)), rows((2, 2), (2, 0), (3, 1)), rows((2, 2), (2, 0), (3, 1)), rows(), rows((None, 5))):
        tables.upsert(batch, path, ["id"], ["at"], 4)
    assert {tuple(r) for r in tables.read(spark, path).select("id", "at").collect()} == {(1, 1), (2, 2), (3, 1), (None, 5)}
    with pytest.raises(RuntimeError):  # a state that another writer made stands
        tables._commit(spark, path, tables._states(spark, path)[-1], {})


JOB = "source_key string, official_url string, event_id long, kind string, meeting_date date, content_length long, etag string, last_modified timestamp, status string, attempts int, error string"


def test_job_life(spark):
    day = datetime.date(2020, 1, 1)
    docs = spark.createDataFrame([(1, "u1", None, "agenda", day, datetime.datetime(2020, 1, 2), 3), (2, "x", 7, "minutes", day, datetime.datetime(2020, 1, 2), 3), (3, "u3", 8, "agenda", day, None, 0)], "id long, official_url string, event_id long, kind string, meeting_date date, indexed_at timestamp, page_count int")
    old = spark.createDataFrame([
        ("same", "s", 1, "agenda", day, 5, "e", None, "complete", 1, None), ("grown", "g", 1, "agenda", day, 5, "e", None, "complete", 1, None), ("unknown", "k", 1, "agenda", day, None, "e", None, "complete", 1, None),
        ("bad", "b", 1, "agenda", day, 5, "e", None, "failed", 2, "boom"), ("gone", "n", 1, "agenda", day, 5, "e", None, "running", 1, None),
    ], JOB)
    found = [("same", "s", 1, 5, None), ("grown", "g", 1, 6, "e"), ("unknown", "k", 1, 9, "e"), ("bad", "b", 1, 5, "e"), ("new", "zz", 99, 1, None), ("there", "other", 7, 1, None)]
    candidates = spark.createDataFrame([(k, u, e, "minutes" if k == "there" else "agenda", day, n, t, None) for k, u, e, n, t in found], JOB.split(", status")[0])
    after = jobs.discovered(old, candidates, docs)
    assert {(r.source_key, r.status, r.content_length, r.error) for r in after.collect()} == {("same", "complete", 5, None), ("grown", "pending", 6, None), ("unknown", "complete", 9, None), ("bad", "pending", 5, None), ("gone", "running", 5, None), ("new", "pending", 1, None), ("there", "complete", 1, None)}
    keys = spark.createDataFrame([("new",), ("grown",), ("same",)], "source_key string")
    taken = jobs.running(jobs.dispatched(after, keys), keys)
    assert {r.source_key for r in taken.where("status = 'running'").collect()} == {"new", "grown", "gone"} and taken.where("source_key = 'new'").first().attempts == 1
    done = jobs.finished(taken.withColumn("official_url", F.when(F.col("source_key") == "new", "u1").otherwise(F.col("official_url"))), docs)
    assert {r.source_key: r.status for r in done.collect()}["new"] == "complete" and {r.source_key for r in jobs.failed(done).where("status = 'failed'").collect()} == {"grown", "gone"}
    assert jobs.matched(spark.createDataFrame([("d", "none", None, "agenda", day, 1, None, None)], JOB.split(", status")[0]), docs).first().document_id == 1


def test_runs_and_what_is_left(spark):
    runs = spark.createDataFrame([], "id string, source string, status string, parser_version string, started_at timestamp, finished_at timestamp, statistics string, error string")
    one = jobs.run_started(runs, "r1", "feed", "2", "2020-01-01 00:00:00")
    two = jobs.run_finished(jobs.run_started(one, "r2", "feed", "2", "2020-01-02 00:00:00"), "r2", "2020-01-02 01:00:00", F.struct(F.lit(3).alias("pages")))
    assert {(r.id, r.status, r.error, r.statistics) for r in two.collect()} == {("r1", "failed", "interrupted", "{}"), ("r2", "complete", None, '{"pages":3}')}
    assert len(jobs.run_finished(one, "r1", "2020-01-01 01:00:00", error="e" * 20_000).first().error) == 10_000
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "c")], "k int, h string")
    done = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "k int, h string")
    assert {r.k for r in jobs.to_do(src, done, "k").collect()} == {None} and {r.k for r in jobs.to_do(src, done, "k", "h").collect()} == {2, None} and jobs.to_do(src, done, "k", force=True).count() == 4
    assert jobs.of_other_version(src, "h", "a").count() == 3 and jobs.preferred(done, src, ["k"]).count() == 4
    log = spark.createDataFrame([("item", "1")], "entity_type string, entity_key string")
    assert [tuple(r) for r in jobs.seeded(log, src.where("k < 3"), "item", "k", "h").collect()] == [("item", "2", "create", "b")]


def test_identifiers_and_parents(spark):
    d = spark.createDataFrame([(1, 7, "g", "u1", "agenda", datetime.date(2020, 1, 1)), (2, 7, None, "u2", "minutes", datetime.date(2020, 1, 3)), (3, None, None, "u3", "agenda", None)], "id long, event_id long, event_guid string, official_url string, kind string, meeting_date date")
    assert {tuple(r) for r in identifiers.identifiers(d.union(d)).collect()} == {(1, "event-id", "7"), (2, "event-id", "7"), (1, "event-guid", "g"), (1, "official-url", "u1"), (2, "official-url", "u2"), (3, "official-url", "u3")}
    assert [tuple(r) for r in identifiers.events(d).collect()] == [(7, "g", datetime.date(2020, 1, 1), "u1", "u2")]
    calls = spark.createDataFrame([(1, 1, "x"), (1, 9, "y")], "document_id long, ordinal int, action string")
    items = spark.createDataFrame([(50, 1, 1)], "id long, document_id long, ordinal int")
    assert [(r.item_id, r.action) for r in identifiers.with_parent(calls, items, ["document_id", "ordinal"], "item_id").collect()] == [(50, "x")]


def test_version_chain(spark):
    page = "document_id int, page_number int, content string"
    v1 = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], page)
    v2 = spark.createDataFrame([(1, 1, "A"), (1, 2, "b"), (1, 3, "c")], page)
    v3 = spark.createDataFrame([(1, 1, "a"), (1, 3, "C")], page)
    archives = versions.archive(v1, v2).withColumn("version_number", F.lit(1)).unionByName(versions.archive(v2, v3).withColumn("version_number", F.lit(2)))
    known = spark.createDataFrame([(1, 1), (1, 2)], "document_id int, version_number int")
    got = {tuple(r) for r in versions.reconstructed(v3, archives, known).collect()}
    assert got == {(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "A"), (1, 2, 2, "b"), (1, 2, 3, "c")}
    assert {tuple(r) for r in versions.diff(v1, v3).collect()} == {(1, 2, "removed"), (1, 3, "added")}
    assert versions.line_diff_of("x\na\nz", "x\nb\nc\nz") == {"start": 1, "removed": ["a"], "added": ["b", "c"], "truncated": False}


def test_feed_and_render(spark):
    rows = spark.range(10)
    assert feed.next_cursor(feed.page(rows, "id", 2, 3), "id", 3) == 5 and feed.next_cursor(feed.page(rows, "id", 8, 3), "id", 3) is None
    seq = feed.numbered(rows.repartition(3), ["id"], 100).collect()
    assert {(r.id, r.seq) for r in seq} == {(i, 101 + i) for i in range(10)}
    assert list(render.ndjson(rows.orderBy("id"), "id", 2))[-1] == '{"_meta": {"nextCursor": "1"}}'
    assert render.page_range("3-5", 9) == (3, 5) and "Night" in render.items_markdown("q", [{"title": "Night", "snippet": "s"}])


def test_stream_upsert_equals_batch(spark, tmp_path):
    from minutebook.streaming import feeds

    src = str(tmp_path / "in")
    for n in range(3):
        spark.createDataFrame([(k, n, n * k) for k in range(4)], "k long, at int, value int").write.mode("append").parquet(src)
    stream = feeds.events(spark, src, "k long, at int, value int", 1)
    for _ in range(2):  # a second run with nothing new changes nothing
        feeds.run_available(stream, feeds.upsert_into(str(tmp_path / "out"), ["k"], ["at"]), str(tmp_path / "cp"))
    assert {tuple(r) for r in tables.read(spark, str(tmp_path / "out")).collect()} == {(k, 2, 2 * k) for k in range(4)}
