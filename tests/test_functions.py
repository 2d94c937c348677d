import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from minutebook.functions import extract, fulltext, fuzzy, intent, text, vectors


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_text_columns(spark):
    assert one(spark, text.name_key, "De la Núñez, Jr.", None, "") == ["delanunezjr", None, ""]
    assert one(spark, text.slug, " José Ríos ", None) == ["jose-rios", None]
    assert one(spark, text.matter_key, "Contract - Proposed Street-Work", "A", None) == ["street work", "a", None]
    assert one(spark, text.action_type, "FINALLY PASSED", "passed on FIRST READING", "adopted", "ADOPTED as amended", "was Continued", None)[:5] == ["final-passage", "first-reading", "other", "adoption", "continuance"]
    assert one(spark, text.is_final, "ADOPTED", "APPROVED ON FIRST READING", "readopted") == [True, False, False]
    assert one(spark, text.file_number, "file 230639 in 2023", "1230639") == ["230639", None]


@pytest.mark.parametrize(("query", "wanted"), [("a", []), ('"unclosed phrase', [["unclosed phrase"]]), ("cats OR dogs -fish", [["cats"], ["dogs", "-fish"]]), ("", []), ("- \"\"", [])])
def test_query_parser(query, wanted):
    assert [[("-" if t.negated else "") + " ".join(t.words) for t in a] for a in fulltext.parse(query)] == wanted


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_query_parses(query):
    fulltext.parse(query)
    fulltext.parse(query, stems=True)
    intent.interpret(query, ["Kim"])


def test_matching(spark):
    match = lambda q: one(spark, lambda c: fulltext.matches(fulltext.analyse(c), q), "Night lighting near the pier", "lighting at night", None)
    assert match("night lighting")[:2] == [True, True]
    assert match('"night lighting"')[:2] == [True, False]
    assert match("pier OR at")[0] is True
    assert match("lighting -pier")[:2] == [False, True]


@pytest.mark.parametrize(("word", "stem"), [("running", "run"), ("relational", "relat"), ("hopping", "hop"), ("agreed", "agre"), ("cities", "citi"), ("ties", "tie"), ("generously", "generous"), ("knightly", "knight"), ("consigned", "consign"), ("sky", "sky")])
def test_stems(word, stem):
    assert fulltext.stem(word) == stem


def test_ranks_and_snippets():
    rank = fulltext.cover_density(["a1", "b1"]).func
    near, far, none = rank(pd.Series([" a1 b1 x ", " a1 x x x b1 ", " x "]))
    assert near > far > none == 0
    cut = fulltext.headline(["pier"], most=4, least=2).func
    assert "pier" in cut(pd.Series(["w " * 50 + "the pier was built"]))[0]
    assert cut(pd.Series([None]))[0] is None


@settings(max_examples=80, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_osa_is_symmetric_and_bounded(a, b):
    d = fuzzy.osa(a, b)
    assert d == fuzzy.osa(b, a) and abs(len(a) - len(b)) <= d <= max(len(a), len(b)) and (d == 0) == (a == b)


def test_amounts(spark):
    texts = [
        "not to exceed $1,500 and increase of $2.5 million in fees, revenue of $3", None, "$, and $.5 of it", "NTE: $7k",
        "x" * 200 + " reduced by $10 b. " + "y" * 200 + " $ 4 of revenue", "funding $5 then $5 funding of $5.00", "$1 " * 30, "w " * 200_000 + "$9",
    ]
    got = [[(a["value"], a["qualifier"]) for a in x] for x in one(spark, extract.amounts, *texts)]
    assert got[0] == [(1500.0, "not-to-exceed"), (2500000.0, "increase"), (3.0, "increase")]
    assert got[1:5] == [[], [], [(7000.0, "not-to-exceed")], [(10e9, "decrease"), (4.0, "revenue")]]
    assert got[5] == [(5.0, "appropriation")] and got[6] == [(1.0, "stated")] and got[7] == [(9.0, "stated")]
    assert one(spark, extract.amounts, texts[5])[0][0]["raw"] == "$5.00"
    assert len(one(spark, extract.amounts, " ".join(f"${n}" for n in range(40)))[0]) == extract.MOST


def test_sponsors(spark):
    got = one(
        spark, extract.sponsors, "Sponsors: Kim,\nLee\nOrdinance amending", None, "Sponsor:\n\n Supervisors Ann and\nBo.\nCy", "intro\nSupervisor Kim, Lee;\nResolution x", "Supervisor Kim moved\nx",
        "x\n" * 9 + "Supervisor Late", "Sponsor: \nMotion y", "Sponsor Supervisor Dee",
    )
    assert got == ["Kim, Lee", None, "Ann and Bo", "Kim, Lee", None, None, None, "Dee"]


def test_facts_of_columns(spark):
    df = spark.createDataFrame([(1, "Lease - Acme Partners", "at 12 N. Main St. and 12 N Main St, 40 new housing units; 1,200 units"), (2, None, None)], "id long, title string, content string")
    r = {x.id: x for x in extract.facts(df).collect()}
    assert r[1].housing_units == [40, 1200] and r[1].parties == ["Acme Partners"] and len(r[1].addresses) == 1
    assert r[2].amounts == [] and r[2].addresses == []
    assert {x.entity_type for x in extract.entities(df).collect()} == {"address", "housing-units", "party"}


def test_cosine_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], [2.0, 0.0]), (1, [0.0, 0.0], [1.0, 0.0]), (2, [1.0], [1.0, 0.0])], "i int, a array<double>, b array<double>")
    assert [r[0] for r in df.orderBy("i").select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_intent():
    i = intent.interpret("How did Kim vote against housing units in 2015 or 1998?", ["Kim"])
    assert (i.voter, i.position, i.from_year, i.to_year, i.query) == ("Kim", "no", 1998, 2015, intent.HOUSING_QUERY)
    assert intent.expand("repairs on Oak St.") == ["repairs on Oak Street."]
    j = intent.interpret("Who testified about trees? https://x.org/2020", ["Kim"])
    assert (j.voter, j.position, j.suggested, j.query, j.from_year) == (None, None, "comments", "testified about trees", intent.FIRST_YEAR)
    assert intent.interpret("why", []).query == "why" and intent.interpret("support or opposition?", []).position == "no"
    k = intent.merged(i, position="aye", to_year=None, final=True)
    assert (k.position, k.to_year, k.final, k.voter) == ("aye", 2015, True, "Kim")
    aliases = {r"\brent control\b": ['"rent control"', '"rent controlled"']}
    assert intent.expand("What is rent control?", aliases) == ['"rent control"', '"rent controlled"', "is rent control"]
    assert intent.expand("what contracts", {}) == ["what agreement", "contracts", "agreement"]
