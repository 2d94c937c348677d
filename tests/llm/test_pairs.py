import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from minutebook.functions.fuzzy import osa
from minutebook.llm import addresses, names, near_duplicates
from minutebook.llm.segment_join import components, near, pairs_within, typing_slip, within
from minutebook.session import cut

ITEM = "id long, title string, content string, rep string, band int"


def items(spark, *rows):
    return spark.createDataFrame([(i, t, c, "clash", 0) for i, t, c in rows], ITEM)


def brute(rows, threshold, n):
    sets = {}
    for i, t, c in rows:
        if i is not None and c:
            w = re.findall("[a-z0-9]+", f"{t or ''} {c}".lower())
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(None, "t", "a b c d"), (1, None, None), (2, "x", ""), (3, None, "a b"), (4, None, "A, b")]
    words = [f"w{k}" for k in range(40)]
    for base in range(12):
        text = r.choices(words, k=60)
        for _ in range(4):
            edited = list(text)
            for _ in range(r.randint(0, 5)):
                edited[r.randrange(len(edited))] = r.choice(words)
            rows.append((len(rows) + 10, "Title", " ".join(edited)))
            rows.append((len(rows) + 10, "TITLE", " ".join(edited).upper()))
    rows.append((900, None, "long text " * 30_000))
    rows.append((901, None, "long text " * 30_000 + "end of it"))
    got = {tuple(x) for x in near_duplicates.item_pairs(items(spark, *rows, *rows[:20])).collect()}
    assert got == brute(rows, 0.7, 3)
    groups = {x.item_id: x for x in near_duplicates.item_groups(items(spark, *rows)).collect()}
    assert groups[3].class_id == groups[4].class_id == 3 and groups[900].group_id == 900
    least = {i: i for i in groups}
    for _ in rows:  # brute force over the pairs
        for a, b in got:
            least[a] = least[b] = min(least[a], least[b])
    assert {i: g.group_id for i, g in groups.items() if i not in (3, 4)} == {i: x for i, x in least.items() if i not in (3, 4)}
    assert all(g.members == sum(h.group_id == g.group_id for h in groups.values()) for g in groups.values())


def test_pairs_of_a_hot_class(spark):
    df = spark.createDataFrame([(i, "hot" if i < 60 else None if i % 2 else f"k{i // 4}", i) for i in range(100)] + [(0, "hot", 7)], "id long, k string, part int")
    want = {(i, j) for i in range(100) for j in range(i + 1, 100) if j < 60 or (i >= 60 and i % 2 == j % 2 == 0 and i // 4 == j // 4)}
    for group in (7, 2000):
        got = [tuple(r) for r in pairs_within(df, ["k"], "id", group).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates.item_pairs(spark.createDataFrame([], ITEM)).count() == 0


def test_band_plan_keeps_its_recall():
    for t in (0.5, 0.7, 0.8, 0.95):
        bands, rows = near_duplicates.band_plan(t)
        assert 1 - (1 - t**rows) ** bands >= 0.999


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.integers(0, 3))
def test_banded_distance(a, b, k):
    assert within(a, b, k) == (osa(a, b) <= k)


def test_segment_join_equals_brute_force(spark):
    r = random.Random(1)
    values = sorted({"".join(r.choices("ab", k=r.randint(4, 9))) for _ in range(150)})
    df = spark.createDataFrame([(f"k{i}", v, i % 2) for i, v in enumerate(values)] + [("kn", None, 0), (None, "abab", 0)], "key string, v string, block int")
    for k in (1, 2):
        want = {tuple(sorted((f"k{i}", f"k{j}"))) for (i, x), (j, y) in itertools.combinations(enumerate(values), 2) if i % 2 == j % 2 and within(x, y, k)}
        assert {(a, b) for a, b, _, _ in near(df, "key", ["block"], "v", k).collect()} == want


def test_segment_join_gathers_nothing(spark):
    few = cut(spark.createDataFrame([(f"k{i}", f"name{i}") for i in range(50)], "key string, v string"))
    for k in (1, 2):  # a small table, but many substrings of it
        assert "BroadcastHashJoin" not in near(few, "key", [], "v", k)._jdf.queryExecution().sparkPlan().toString()


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (101, 102)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(51)) and got[102] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


SAME = [
    ["Owen Quillane", "OWEN QUILLANE", "Quillane, Owen", "O. Quillane", "Supervisor O. Quillane", "Owen N. Quillane", "Oeen Quillane", "Quillane O"],
    ["Katarina Quillane", "K. Quillane", "Katarina Quillaen"],
    ["Hargreen", "Anthony Hargreen", "Tony Hargreen", "Harg reen", "Harg-reen", "Hagreen", "Sup. Hargreen"],
    ["Joaquín De la Cruzane", "De la Cruzane", "DelaCruzane", "De 1a Cruzane", "De la Cruzane J"],
    ["Druquo Tenants Association", "The Druquo Tenants Association", "Druquo Tenants Assn.", "Tenants Association (Druquo)", "Durquo Assn. of Tenants"],
    ["Druquo Community Development Corporation", "Druquo CDC"],
    ["Ivan Hobtamulm", "Hobtamulm Ivan", "Ivan Hobtamulm (owner)"], ["Ivan Pemtovcro"], ["Peñarosa", "Prñarosa", "Penarosa"],
    ["Marcus Hollingsworth", "Marcus Holingswroth", "Marcuss Hollingswroth"], ["Alexander Stone", "Alex Stone"], ["Sebastian Marlow", "Seb Marlow", "Marlow, Sebastian"],
    ["Ana Wong", "Ana Wnog"], ["Ana Lee", "Ana Leee"], ["Ana Leo"], ["Priya Tolverand"], ["Priya Tolvimond"], ["Maria Ostrander"], ["Mark Ostrander"],
    ["St. Luke's Hospital", "Hospital St Luke"], ["Bayview Bakery Cooperative", "Cooperative Bayview Bakery", "Bayveiw Bakery Coop"],
    ["Quellan Workers Union Local 12", "Quellan Wkrs Union, Loc. 12"], ["Quellan Workers Union Local 21"], ["Quellan Library Foundation"],
]


def test_names(spark):
    every = [n for g in SAME for n in g]
    df = spark.createDataFrame([(n, "c") for n in [*every, *every[:5], None, "", "  ", "Speaker", "Unidentified Speaker"]], "name string, node string").select("name")
    got = {tuple(r) for r in names.spelling_pairs(df).collect()}
    want = {tuple(sorted(p)) for g in SAME for p in itertools.combinations(g, 2)}
    assert want - got == set() and got - want == set()
    assert names.spelling_pairs(df.limit(0)).count() == 0
    assert names.read("x" * 100_000)[2] == "x" * 100_000


def test_typed_names_of_tables(spark):
    calls = spark.createDataFrame([(["A B", "A B"], [None, "C"]), ([], None)], "ayes array<string>, noes array<string>")
    speakers = spark.createDataFrame([("D",), (None,), ("A B",)], "speaker string")
    assert {tuple(r) for r in names.typed_names(calls, speakers).collect()} == {("A B", 3), ("C", 1), ("D", 1)}


def test_short_forms_from_the_names_themselves(spark):
    people = [(f"{g} {f}",) for f in ("Arbuth", "Bellow", "Corvan", "Dunmar") for g in ("Horatio", "Tio")] + [(f"{g} Smith",) for g in ("Horatio", "Ada", "Bo", "Cy")]
    df = spark.createDataFrame(people, "name string")
    got = {tuple(r) for r in names.spelling_pairs(df).collect()}
    assert got == {(f"Horatio {f}", f"Tio {f}") for f in ("Arbuth", "Bellow", "Corvan", "Dunmar")}


def test_short_forms_from_large_families(spark):
    r = random.Random(3)
    fresh = lambda: "".join(r.choices("bdfgklmnprstvz", k=9)).capitalize()
    large = [[fresh(), *[fresh() for _ in range(13)]] for _ in range(12)]
    for k, family in enumerate(large):
        family += ["Horatio", "Tio"] * (k < 4) + ["Quimby"] * (k > 1) + ["Xob"] * (k > 8)  # Xob meets Quimby by chance
    df = spark.createDataFrame([(f"{g} {family[0]}",) for family in large for g in family[1:]], "name string")
    got = {tuple(x) for x in names.spelling_pairs(df).collect()}
    assert got == {(f"Horatio {family[0]}", f"Tio {family[0]}") for family in large[:4]}


def test_slips_and_abbreviations():
    assert all(typing_slip(a, b) for a, b in (("hollingsworth", "holingswroth"), ("lee", "leee"), ("wong", "wnog"), ("abcdefghij", "abdcefghi")))
    assert not any(typing_slip(a, b) for a, b in (("tolverand", "tolvimond"), ("leo", "lee"), ("siltrastpul", "siltrastpem")))
    assert all(names._abbreviates(a, b) for a, b in (("assn", "association"), ("nhood", "neighborhood"), ("co", "company"), ("dev", "development")))
    assert not any(names._abbreviates(a, b) for a, b in (("an", "andrews"), ("bay", "bayu"), ("council", "council"), ("tow", "workers")))


PLACES = [
    ["1401 Nirksevkep Avenue", "Nirksevkep Avenue, l4Ol", "1401 Nirksevkep Ave. Unit C, Port Aldery 00102", "Port Aldery: 1401 Nirksevkep", "1401 Nirksevekp Av"],
    ["455 Kepcrolunt Road N, Unit B", "455 No. Kepcrolunt Rd", "N KEPCROLUNT ROAD, 455, TILLBROOK", "Tillbrook: 455 North Kepcrolunt Road #3"],
    ["455 South Kepcrolunt Road", "South Kepcrolunt Rd. No. 455"], ["3500 7th Street", "Seventh St., 3500", "7TH St. No. 3500"], ["3500 7th Avenue"],
    ["12 Rasttovzig Lane"], ["12 Rasttovzig Drive"], ["1402 Nirksevkep Avenue"], ["12 Rasttovzig"], ["12 Rasttovzig, Overton"],
    ["12 Old Mill Road", "12 Old Mill", "Old Mill, 12, Tillbrook", "12 Old Mill Tillbrook", "Old Mil Rd 12"],
    ["12 Pine Street, Springfield", "12 Pine, Springfield", "Springfeild: 12 Pine", "12 Pine 00401"], ["12 Pine Avenue, Shelbyville", "12 Pine, Shelbyville"], ["14 Pine Street, Springfield 00401"],
    ["7 Elm Street", "7 Elm St", "7 Elm St.", "7 Emm Street"], ["8 Elk Street"], ["21 Twenty First Avenue", "21 21st Ave"], ["3 A Street"], ["3 B Street"],
]


def test_addresses(spark):
    flat = [(k, a) for k, a in enumerate(a for g in PLACES for a in g)]
    number = {a: k for k, a in flat}
    df = spark.createDataFrame([(1, [k for k, _ in flat], [a for _, a in flat], "x"), (2, [], [], "x"), (3, None, None, "x"), (4, [900, None, 901], [None, "5 A St", "Old Mill Road"], "x"), (1, [0], [flat[0][1]], "x")], "fact_id long, address_ids array<long>, addresses array<string>, name string")
    got = {tuple(r) for r in addresses.same_building(addresses.records(df)).collect()}
    assert got == {tuple(sorted((number[x], number[y]))) for g in PLACES for x, y in itertools.combinations(g, 2)}
    levels = {r.address_id: r for r in addresses.resolved(addresses.records(df)).collect()}
    assert levels[number["12 Rasttovzig"]].candidates == ["rasttovzig drive", "rasttovzig lane"] and levels[number["12 Rasttovzig"]].level == "locality"
    assert levels[901].level == "street" and levels[number["455 No. Kepcrolunt Rd"]].level == "number" and levels[number["Springfeild: 12 Pine"]].town == "springfield"
    assert addresses.same_building(addresses.records(df.limit(0))).count() == 0
