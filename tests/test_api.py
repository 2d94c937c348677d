import datetime

import pytest
from pyspark.sql import functions as F

from minutebook import api
from minutebook.functions import linking
from minutebook.operators import evidence, postings, render
from minutebook.sources import records


def test_defaults_and_bounds():
    assert api.check("search", {"q": " trees ", "year": "2010", "junk": "x"}) == {
        "q": "trees", "from": 2010, "to": 2010, "limit": 20, "format": "json", "year": 2010, "kind": None, "type": "all", "voter": None, "position": None, "final": False, "mode": "hybrid",
    }
    votes = api.check("aggregates/votes", {"voter": "Kim", "final": "true"})
    assert votes["limit"] == 100 and votes["groupBy"] == "file" and votes["final"] and votes["to"] == datetime.date.today().year
    assert api.check("changes", {"since": "2020-01-02T00:00:00"})["since"].year == 2020 and api.check("quality", {}) == {}


@pytest.mark.parametrize(("entry", "request_"), [
    ("search", {}), ("search", {"q": "x"}), ("search", {"q": "x" * 301}), ("search", {"q": "trees", "limit": "51"}), ("search", {"q": "trees", "limit": "-1"}), ("search", {"q": "trees", "from": "2012", "to": "2010"}), ("search", {"q": "trees", "kind": "memo"}),
    ("search", {"q": "trees", "year": "1995"}), ("items", {"q": "trees", "position": "aye"}), ("items", {"q": "trees", "final": "maybe"}), ("aggregates/housing", {"voter": "Kim", "groupBy": "roll-call"}), ("aggregates/votes", {"voter": "K"}),
    ("snapshots", {"entity": "pages"}), ("snapshots", {"entity": "documents", "limit": "1001"}), ("documents/diff", {"id": "1", "from": "2", "to": "2"}), ("documents", {"id": "0"}), ("query", {"q": "x" * 501}),
])
def test_refused(entry, request_):
    with pytest.raises(ValueError):
        api.check(entry, request_)


def test_json_rpc():
    tools = {"search_records": lambda v: f"{v['q']} {v['limit']}"}
    ask = lambda method, **params: api.call({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}, tools)
    assert ask("ping")["result"] == {} and "tools" in ask("initialize")["result"]["capabilities"]
    listed = ask("tools/list")["result"]["tools"]
    assert [t["name"] for t in listed] == ["search_records"] and listed[0]["inputSchema"]["required"] == ["q"]
    assert ask("tools/call", name="search_records", arguments={"q": "trees", "limit": 3})["result"]["content"][0]["text"] == "trees 3"
    assert ask("tools/call", name="search_records", arguments={"q": "x"})["result"]["isError"]
    assert ask("tools/call", name="other")["error"]["code"] == -32602 and ask("nothing")["error"]["code"] == -32601


def test_names_in_text(spark):
    s = spark.createDataFrame([
        (1, "ann-m-lee", "Ann M. Lee", "Lee", True, datetime.date(2000, 1, 1), datetime.date(2004, 1, 1)), (2, "bo-lee", "Bo Lee", "Lee", True, datetime.date(2005, 1, 1), datetime.date(2009, 1, 1)), (3, "cy", "Cy D'Ôr", None, True, None, None),
    ], "id long, slug string, display_name string, family_name string, active boolean, term_start date, term_end date")
    links = linking.name_links(s, spark.createDataFrame([(1, "Annie Lee"), (2, None)], "supervisor_id long, alias string"))
    assert {r.slug: r.names for r in links.collect()} == {"ann-m-lee": ["Ann M. Lee", "Ann Lee", "Lee", "Annie Lee"], "bo-lee": ["Bo Lee", "Lee"], "cy": ["Cy D'Ôr"]}
    rows = [(1, "Annie Lee and LEE, not Leeward or x@Lee.org or lee; cy d'ôr, Cy D'Ôr, Lee.", datetime.date(2001, 5, 5)), (2, "Lee", datetime.date(2006, 1, 1)), (3, None, None), (4, "", None), (5, "Lee " * 5000, datetime.date(2006, 1, 1))]
    got = linking.linked(spark.createDataFrame(rows, "k int, t string, day date"), "k", "t", "day", links, 2026).collect()
    assert {tuple(r) for r in got if r.k < 5} == {(1, 1, "Annie Lee", "ann-m-lee"), (1, 2, "LEE", "ann-m-lee"), (1, 5, "Cy D'Ôr", "cy"), (2, 1, "Lee", "bo-lee")} and sum(r.k == 5 for r in got) == 5000
    assert linking.linked(spark.createDataFrame(rows, "k int, t string, day date"), "k", "t", "day", links.limit(0), 2026).count() == 0


def test_contacts_and_districts(spark):
    whole = '{"contact": {"address": "a", "email": "e", "phone": "p", "website": "w", "aides": "x"}}'
    df = spark.createDataFrame([(1, whole, "04", "s"), (2, whole.replace('"e"', '" "'), None, "s"), (3, None, " ", "t"), (4, "{", "At-large", "t")], "i int, m string, d string, slug string")
    got = {r.i: (r.c, r.x) for r in df.select("i", linking.contact(F.col("m")).alias("c"), linking.district(F.col("d"), F.col("slug"), {"s": "9"}).alias("x")).collect()}
    assert got[1][0]["email"] == "e" and [got[i][0] for i in (2, 3, 4)] == [None] * 3 and [got[i][1] for i in (1, 2, 3, 4)] == ["4", "9", None, "At-large"]


def test_calls_that_bear_on_a_question(spark):
    calls = spark.createDataFrame([(i, 1, i, f"a{i}", "other", i in (2, 3), ["Kim"] if i == 3 else [], ["Lee"] if i == 1 else [], [], []) for i in range(1, 6)], "id long, item_id long, sequence int, action string, action_type string, is_final boolean, ayes array<string>, noes array<string>, absent array<string>, excused array<string>")
    nested = evidence.nested_calls(calls.union(calls))
    shown = lambda *a: nested.select(evidence.shown_call(F.col("calls"), *a)["id"]).first()[0]
    bears = lambda *a: [c.id for c in nested.select(evidence.relevant_calls(F.col("calls"), *a)).first()[0]]
    assert (shown("Kim", "aye"), shown("Lee", "no"), shown()) == (3, 2, 2)
    assert (bears("Lee", "no"), bears("Nobody"), bears()) == ([1], [1, 2], [1, 2, 3, 4])


def test_postings_with_stems_and_fields(spark):
    rows = spark.createDataFrame([(1, "Hearing", "on the libraries of the city"), (2, None, "library hearing"), (3, "hear", "the library was closed"), (4, "", None), (1, "Hearing", "on the libraries of the city")], "id long, title string, content string")
    index = postings.postings(rows, "id", {"title": 1.0, "content": 0.4}, stems=True)
    find = lambda q: {r.key for r in postings.search(index, q, stems=True).collect()}
    assert find("hearings library") == {1, 2, 3} and find('"library hearing"') == {2} and find("library -closed") == {1, 2} and find("the") == set() and find("-closed") == set()
    assert find("city OR closed") == {1, 3} and postings.search(index.limit(0), "city").count() == 0
    best = [r.key for r in postings.search(index, "hearing", stems=True).orderBy(F.desc("score")).collect()]
    assert best[-1] == 2  # a word of a title weighs more


def test_readers_of_markup_and_json(spark):
    feed = spark.createDataFrame([("<item><link>x?ID=7&amp;GUID=ab-1</link><title>Board 1/2/2020</title></item><item><link>x</link></item>",)], "xml string")
    assert [(r.event_id, r.event_guid, str(r.meeting_date)) for r in records.feed_events(feed, "xml").collect()] == [(7, "AB-1", "2020-01-02")]
    page = spark.createDataFrame([('<tr><td>1/2/2020</td><a href="v?M=A&amp;ID=7&amp;GUID=AB-1"></a><a href="v?M=M&ID=7&GUID=AB-1"></a></tr><tr>no date<a href="v?M=A&ID=8&GUID=C"></a></tr>',)], "m string")
    assert {(r.source_key, r.kind) for r in records.calendar_rows(page, "m").collect()} == {("7:agenda", "agenda"), ("7:minutes", "minutes")}
    old = spark.createDataFrame([('<a href="x/bag010298.pdf">a</a><a href="bag139999.pdf">b</a>',)], "m string")
    assert [(str(r.meeting_date), r.url) for r in records.archive_links(old, "m").collect()] == [("1998-01-02", "x/bag010298.pdf")]
    past = spark.createDataFrame([("01/08/1990 to 01/08/1995",), ("1/8/1996, 01/08/2001",), ("none",), ("01/08/1997 01/09/2001",)], "t string")
    assert [(str(r.first_date), r.district_default) for r in records.former_members(past, "t").orderBy("first_date").collect()] == [("1996-01-08", "At-large"), ("1997-01-08", None)]
    few, known = spark.createDataFrame([("a",), ("b",), ("b",)], "slug string"), spark.createDataFrame([("k",)], "slug string")
    assert [r.slug for r in records.roster(few, known, 3).collect()] == ["k"] and records.roster(few, known, 2).count() == 2
    answers = spark.createDataFrame([('[{"MatterId": 1, "MatterFile": " 230001 ", "MatterTitle": "T", "MatterPassedDate": "2020-01-02T00:00:00"}, {"MatterFile": "x"}]',), ("not json",), (None,), ('[{"MatterId": 1, "MatterFile": "230001", "MatterTitle": "U"}]',)], "a string")
    assert [(r.matter_id, r.file_number, r.title, str(r.passed)) for r in records.matters(answers, "a").collect()] == [(1, "230001", "T", "2020-01-02")]


def test_renderers():
    md = render.bundle_markdown("Why?", [{"part": "item", "rank": 1, "id": "7", "title": "Night", "body": '{"score": 1.5, "calls": [{"id": 1}]}'}, {"part": "housing", "rank": 1, "id": None, "title": "Kim", "body": '{"units": 3}'}])
    assert "## Items" in md and "1. Night (7)" in md and "## Housing" in md and "## Pages" not in md
    assert "> two words" in render.comments_markdown("q", [{"speaker": None, "content": "two\n words"}]) and "| 2020 | 1 | aye | a\\|b |" in render.votes_markdown("Kim", [{"meeting_date": 2020, "file_number": 1, "position": "aye", "title": "a|b"}], {"aye": 1})


def test_overlap_and_sitemap(spark):
    df = spark.createDataFrame([(1, 1, 3), (2, 4, 9)], "id int, a int, b int")
    assert [r.id for r in df.where(render.overlapping(F.col("a"), F.col("b"), 3, 3)).collect()] == [1]
    s, d = spark.createDataFrame([("ann",)], "slug string"), spark.createDataFrame([(5,)], "id long")
    assert {r.url for r in render.sitemap(["/"], s, d).collect()} == {"/", "/supervisors/ann", "/documents/5"}
