import datetime as dt

from pyspark.sql import functions as F

from minutebook.operators import history

SCHEMA = "feed string, supervisor_id long, district string, active boolean, term_start string, snapshot_date date, captured_at timestamp, attribute_hash string, _year int"
KEYS, AT, NAMES = ["feed", "supervisor_id"], "snapshot_date", ["district", "active", "term_start"]


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def rows(*x):
    return [(f, s, d, a, t, day(n), dt.datetime(2020, 1, 1) + dt.timedelta(hours=h), "extra", 1) for f, s, d, a, t, n, h in x]


def found(df):
    return {(r.feed, r.supervisor_id, r.district, r.valid_from, r.valid_to) for r in history.supervisor_versions(df).collect()}


def test_runs_corrections_and_returns(spark):
    df = spark.createDataFrame(rows(
        ("a", 1, "4", True, "2020-01-08", 0, 1), ("a", 1, "District 04", True, "01/08/2020", 400, 2), ("a", 1, "5", True, "January 8, 2020", 500, 3),
        ("a", 1, "6", True, "2020-01-08", 500, 9), ("a", 1, "4", True, "2020-01-08T00:00:00Z", 600, 4), ("a", 1, "4", True, "2020-01-08", 600, 4), ("b", 1, None, None, None, 3, 1),
    ), SCHEMA)
    assert found(df) == {("a", 1, "4", day(0), day(500)), ("a", 1, "6", day(500), day(600)), ("a", 1, "4", day(600), None), ("b", 1, None, day(3), None)}


def test_ties_nulls_and_empty_tables(spark):
    df = spark.createDataFrame(rows(("a", None, "1", True, None, 0, 1), ("a", None, "2", True, None, 0, 1)), SCHEMA)
    one = found(df)
    assert len(one) == 1 and one == found(df.orderBy(F.desc("district")))
    assert found(spark.createDataFrame([], SCHEMA)) == set()
    assert found(df.withColumn("snapshot_date", F.lit(None).cast("date"))) == set()


def test_merges_equal_the_full_history(spark):
    """Deliveries in random order of dates, so that many are late or corrections, merged in 1, 2 and 5 steps."""
    import random

    r = random.Random(3)
    data = rows(*[(r.choice("ab"), r.choice([1, 2, None]), str(r.randint(1, 2)), True, None, r.randint(0, 20) * 30, n) for n in range(90)])
    df = spark.createDataFrame(data, SCHEMA)
    attributes = {n: F.col(n) for n in NAMES}
    want = sorted(map(str, history.versions(df, KEYS, AT, attributes, "captured_at").collect()))
    assert len(want) > 20
    for steps in (1, 3):
        got = history.folded(df, KEYS, AT, attributes, "captured_at", steps)
        assert sorted(map(str, got.collect())) == want


def test_merge_in_order_closes_and_opens(spark):
    attributes = {n: F.col(n) for n in NAMES}
    settle = lambda *x: history.settled(spark.createDataFrame(rows(*x), SCHEMA), KEYS, AT, attributes, "captured_at")
    known = settle(("a", 1, "4", True, None, 0, 1), ("b", 1, "9", True, None, 5, 1))
    first = history.runs(known, KEYS, AT, NAMES)
    same, known2 = history.merge(first, known, settle(("a", 1, "4", True, None, 10, 2)), KEYS, AT, NAMES, "captured_at")
    assert {(x.feed, x.valid_from, x.valid_to, x.seen_to) for x in same.collect()} == {("a", day(0), None, day(10)), ("b", day(5), None, day(5))}
    late, _ = history.merge(same, known2, settle(("a", 1, "5", True, None, 4, 3)), KEYS, AT, NAMES, "captured_at")
    assert {(x.feed, x.district, x.valid_from, x.valid_to) for x in late.collect()} == {("a", "4", day(0), day(4)), ("a", "5", day(4), day(10)), ("a", "4", day(10), None), ("b", "9", day(5), None)}
