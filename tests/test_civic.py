import datetime

import pytest
from pyspark.sql import functions as F

from minutebook.plans import civic

ITEM = "id long, document_id long, ordinal int, start_page int, end_page int, file_number string, title string, content string, matter string"
DOCUMENT = "id long, meeting_date date, year int, kind string"
CALL = "id long, item_id long, is_final boolean"
COMMENT = "id long, document_id long, ordinal int, page_number int, speaker string, content string"
PAGE = "id long, document_id long, page_number int, content string"


@pytest.fixture
def tables(spark, monkeypatch):
    """Queries of the plan read the rows of this dict, by table."""
    rows = {
        "legislative_items": ([], ITEM),
        "meeting_documents": ([(1, datetime.date(2015, 3, 1), 2015, "minutes")], DOCUMENT),
        "roll_calls": ([], CALL),
        "public_comments": ([], COMMENT),
        "pages": ([], PAGE),
    }
    monkeypatch.setattr(civic, "table", lambda spark, sf, name: spark.createDataFrame(*rows[name]))
    return rows


def item(i, title, content="", number=None):
    return (i, 1, i, 1, 1, number, title, content, None)


def test_unified_search_ranks_the_vectors_of_all_items(spark, tables):
    tables["legislative_items"] = ([item(1, "tenant relocation"), item(2, "relocation"), item(3, "harbor dredging")], ITEM)
    rows = {r.key: r for r in civic.s05_unified_search(spark, "").collect()}
    assert rows["item:1"].list_no == 1 and rows["item:1"].cosine > rows["item:2"].cosine > 0
    assert rows["item:2"].list_no is None and rows["item:2"].result_type == "semantic" and rows["item:2"].title == "relocation"  # by vector alone, without all words of the question


EMBEDDING = "vec_id long, embedding array<float>, label int"


def test_rank_fusion_and_rerank_take_all_vectors(spark, tables):
    # rows beyond the first 91 are nearest to the query vector and first of the lexical list
    rows = [(i, [1.0, 0.0] if i == 1 or i >= 110 else [0.0, 1.0], 0 if i in (114, 137) else 1) for i in range(140)]
    tables["embeddings"] = (rows, EMBEDDING)
    fused = [r.key for r in civic.v06_rank_fusion(spark, "").collect()]
    assert fused[:2] == [114, 137] and {110, 111} <= set(fused)
    assert {r.vec_id for r in civic.v02_hybrid_rerank(spark, "").collect()} == set(range(140))


def test_searches_find_other_forms_of_words(spark, tables):
    from minutebook.operators import search

    tables["legislative_items"] = ([item(1, "Hearings on libraries", number="230001"), item(2, "Hearing of the library", number="230002"), item(3, "Hearing only")], ITEM)
    tables["public_comments"] = ([(1, 1, 1, 1, "Kim", "two libraries")], COMMENT)
    tables["pages"] = ([(1, 1, 1, "both libraries"), (2, 1, 2, None)], PAGE)
    found = civic.s02_item_search_stemmed(spark, "").collect()
    assert {r.item_id for r in found} == {1, 2} and all(r.score > 2 for r in found) and found[0].total == 2
    t = lambda name: civic.table(spark, "", name)
    for stems in (True, False):
        o = search.Options("library", expand=False, stems=stems)
        assert search.comments(t("public_comments"), t("meeting_documents"), o).count() == stems
        assert search.pages(t("pages"), t("meeting_documents"), t("legislative_items"), o).count() == stems


def test_preview_has_no_cap(spark, tables, monkeypatch):
    limits = []
    whole = civic.search.preview
    monkeypatch.setattr(civic.search, "preview", lambda rows, column, query, limit=None: limits.append(limit) or whole(rows, column, query, limit))
    tables["public_comments"] = ([(1, 1, 1, 1, "Kim", "a tree"), (2, 1, 2, 1, "Kim", "tree budget"), (3, 1, 3, 1, "Kim", "other")], COMMENT)
    assert [(r.comment_id, r.hits) for r in civic.s09_preview(spark, "").collect()] == [(2, 2), (1, 1)]
    assert limits == [None]


def test_reconciled_reads_positions_once(spark):
    from minutebook.operators import votes

    calls = spark.createDataFrame([(1, 7, 1, "x", True, ["Lee", "Lee", "Ann Lee", None], ["Roe"], [], []), (1, 7, 1, "x", True, ["Lee", "Lee", "Ann Lee", None], ["Roe"], [], []), (2, 8, 1, "x", True, ["LEE"], [], ["Nobody"], [])], "id long, item_id long, sequence int, action_type string, is_final boolean, ayes array<string>, noes array<string>, absent array<string>, excused array<string>")
    dated = spark.createDataFrame([(7, "2010-05-01", "F7"), (8, None, "F8")], "item_id long, meeting_date string, file_number string").withColumn("meeting_date", F.col("meeting_date").cast("date"))
    members = spark.createDataFrame([(1, "Ann Lee", "Lee", "ann-lee", "2000-01-01", None), (2, "Bo Lee", "Lee", "bo-lee", "2008-01-01", "2012-01-01"), (3, "Cy Roe", "Roe", "cy-roe", None, "2005-01-01")], "id long, display_name string, family_name string, slug string, term_start string, term_end string")
    members = members.withColumns({c: F.col(c).cast("date") for c in ("term_start", "term_end")})
    got = votes.reconciled(votes.positions(calls), dated, members)
    rows = sorted((r.roll_call_id, r.recorded_name or "", r.position, r.file_number, r.supervisor_id, float(r.confidence)) for r in got.collect())
    assert rows == [(1, "", "aye", "F7", None, 0.5), (1, "Ann Lee", "aye", "F7", 1, 1.0), (1, "Lee", "aye", "F7", 2, 0.98), (1, "Roe", "no", "F7", 3, 0.9), (2, "LEE", "aye", "F8", None, 0.5), (2, "Nobody", "absent", "F8", None, 0.5)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(ayes") + got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(t") <= 2
