"""Address records of the same building (problem 4).

A record is read into levels: region (postal code), locality (town), street (name, direction, type), house number,
unit. The levels are linked from the top. Spellings of towns are linked; a record without a town inherits the towns of
its postal code as candidates. A street name is linked among the spellings of the towns that are left, a rare one
giving way to a frequent one within one edit; words without a street type are split into name and town as the linked
levels say. A street without its type inherits the streets of its name, those of its candidate towns if there are any.
Where more than one is left the record stays open, with its candidates, and is joined with nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minutebook.llm.segment_join import near, pairs_within
from minutebook.session import cut

# Street types with their abbreviations, directions, ordinals.
TYPES = """
avenue av ave aven|boulevard bl blv blvd boul|circle cir circ|court crt ct|drive dr drv|highway hwy hiway|lane la ln|parkway pkwy pky|place pl plc|plaza plz|
road rd|row|square sq|street st str strt|terrace ter terr tce|trail trl|walk wk|way wy|alley aly|loop|crescent cres
"""
DIRECTIONS = "north n no|south s so|east e|west w|northeast ne|northwest nw|southeast se|southwest sw"
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
UNIT_WORDS = set("suite ste unit apt apartment room rm floor fl flr # po box bldg building".split())


def _variants(text: str) -> dict[str, str]:
    return {w: words[0] for group in text.replace("\n", "").split("|") for words in [group.split()] for w in words}


TYPE_OF, DIRECTION_OF = _variants(TYPES), _variants(DIRECTIONS)
ORDINAL_OF = {w: i + 1 for i, w in enumerate(ORDINALS)}
_DIGITS = str.maketrans("loisbOIS|", "101580151")


def _number(w: str) -> str | None:
    """A house number, also where letters stand for digits, perhaps with a letter after it."""
    if not re.search(r"\d|^[loOI]{2,}$", w) and not re.fullmatch(r"[lLoOiI|]+", w):
        return None
    m = re.fullmatch(r"([0-9lLoOiIsSbB|]+)([a-z]?)", w)
    if not m:
        return None
    digits = m[1].lower().translate(_DIGITS)
    return (digits.lstrip("0") or "0") + m[2] if digits.isdigit() else None


def _ordinal(w: str) -> str | None:
    m = re.fullmatch(r"([0-9loi]+)(st|nd|rd|th)", w)
    if m:
        d = m[1].translate(_DIGITS)
        return f"{int(d)}th" if d.isdigit() else None
    return f"{ORDINAL_OF[w]}th" if w in ORDINAL_OF else None


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


#: A street name without a type has at most so many words; what follows is its town.
NAME_WORDS = 6


def _name(words: list[str]) -> str:
    """One spelling of a street name: ordinals as 21th, letters for the digits that scans put among them."""
    if len(words) == 1 and (ordinal := _ordinal(words[0])):
        return ordinal
    if len(words) == 2 and words[0] in TENS and words[1] in ORDINAL_OF:
        return f"{TENS[words[0]] + ORDINAL_OF[words[1]]}th"
    return re.sub(r"[^\w]", "", "".join(words)).replace("0", "o").replace("1", "l").replace("5", "s")


def read(address: str | None) -> dict[str, object] | None:
    """number, direction, type, unit, postal and readings of an address: readings are pairs of a street name and a town
    (or None), one where the type or a comma tells them apart. None if no street can be read; the number may be
    missing."""
    if not address or not address.strip():
        return None
    text = _plain(address)
    out: dict[str, object] = dict.fromkeys(("number", "direction", "type", "unit", "town", "postal"))
    if m := re.match(r"\s*([a-z][a-z .'-]*):\s*(.*)", text, re.S):
        out["town"], text = re.sub(r"\s+", " ", m[1]).strip(), m[2]
    if m := re.search(r"[\s,]([0-9]{5})(-[0-9]{4})?\s*$", text):
        out["postal"], text = m[1], text[: m.start()]
    unit = r"(?:(?:suite|ste|unit|apt|apartment|room|rm)\b\.?\s*#?\s*([0-9]+[a-z]?|[a-z])\b|#\s*([0-9]+[a-z]?|[a-z])\b|\b([0-9l]+)(?:st|nd|rd|th)\s+(?:floor|fl|flr)\b\.?|\b(?:floor|fl|flr)\b\.?\s*([0-9]+)\b)"
    if m := re.search(unit, text):
        out["unit"] = next(x for x in m.groups() if x)
        text = text[: m.start()] + " , " + text[m.end() :]
    tokens = re.findall(r"[^\W_]+(?:['’-][^\W_]+)*\.?|,", text)
    words = [t.rstrip(".") for t in tokens]
    n = len(words)

    def followed_by_number(i: int) -> bool:
        return words[i] in ("no", "number", "nr") and i + 1 < n and _number(words[i + 1]) is not None and _ordinal(words[i + 1]) is None

    used = [w == "," for w in words]
    number = None
    for i in range(n):
        if followed_by_number(i) and (i > 0 or n == 2):
            number = i + 1
            used[i] = used[i + 1] = True
            break
    if number is None:
        found = [i for i in range(n) if not used[i] and _number(words[i]) is not None and _ordinal(words[i]) is None]
        # a letter alone that looks like a digit is a direction or a unit unless nothing else is left
        found = [i for i in found if re.search(r"\d", words[i])] or [i for i in found if len(words[i]) > 1] or found
        number = found[0] if found else -1
        if found:
            used[number] = True
    out["number"] = _number(words[number]) if number >= 0 else None

    groups: list[list[int]] = [[]]  # words between commas, without the number
    for i in range(n):
        if words[i] == ",":
            groups.append([])
        elif not used[i]:
            groups[-1].append(i)
    groups = [g for g in groups if g]
    if not groups:
        return None
    typed = [g for g in groups if any(words[i] in TYPE_OF and k > 0 for k, i in enumerate(g))]
    beside = [g for g in groups if number >= 0 and any(abs(i - number) == 1 for i in g)]
    street = (typed or beside or groups)[0]
    rest = [g for g in groups if g is not street]

    body = [words[i] for i in street]
    if len(body) > 1 and body[0] in DIRECTION_OF:
        out["direction"], body = DIRECTION_OF[body[0]], body[1:]
    at = next((k for k in range(1, len(body)) if body[k] in TYPE_OF), None)
    if at is not None:
        out["type"] = TYPE_OF[body[at]]
        after, body = body[at + 1 :], body[:at]
        if after and after[0] in DIRECTION_OF and out["direction"] is None:
            out["direction"], after = DIRECTION_OF[after[0]], after[1:]
        if after and out["town"] is None:
            out["town"] = " ".join(after)
    if out["town"] is None and rest:
        left = [" ".join(words[i] for i in g) for g in rest]
        out["town"] = next((x for x in left if not re.search(r"\d", x)), None)
    splits = [(body, out.pop("town"))]
    if at is None and len(body) > 1:  # no type: a direction ends the name, else the name may end at any word
        turn = next((k for k in range(1, len(body)) if body[k] in DIRECTION_OF and out["direction"] is None), None)
        if turn is not None:
            out["direction"] = DIRECTION_OF[body[turn]]
            splits = [(body[:turn], splits[0][1] or " ".join(body[turn + 1 :]) or None)]
        elif splits[0][1] is None:
            splits = [(body[:k], " ".join(body[k:]) or None) for k in range(1, min(len(body), NAME_WORDS) + 1)]
    out["readings"] = [(n, t) for n, t in ((_name(b), t) for b, t in splits) if n]
    return out if out["readings"] else None


FIELDS = ("number", "direction", "type", "unit", "postal")
READING = pa.list_(pa.struct([("name", pa.string()), ("town", pa.string())]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(key, r) for key, r in zip(batch.column(0).to_pylist(), map(read, batch.column(1).to_pylist())) if r is not None]
        readings = [[{"name": n, "town": t} for n, t in r["readings"]] for _, r in rows]
        cols = [pa.array([k for k, _ in rows], pa.int64()), *[pa.array([r[f] for _, r in rows], pa.string()) for f in FIELDS], pa.array(readings, READING)]
        yield pa.RecordBatch.from_arrays(cols, ["address_id", *FIELDS, "readings"])


def records(facts: DataFrame) -> DataFrame:
    """(address_id, address): one row an address record. Where the arrays differ in length or an id is null, only
    whole pairs count; an id that comes twice counts once."""
    pairs = facts.select(F.explode(F.arrays_zip("address_ids", "addresses")).alias("p")).select(F.col("p.address_ids").alias("address_id"), F.col("p.addresses").alias("address"))
    return pairs.where(F.col("address_id").isNotNull() & F.col("address").isNotNull()).groupBy("address_id").agg(F.max("address").alias("address"))


def _looks(name: str) -> Column:
    """What scans confuse counts as the same."""
    return F.regexp_replace(F.regexp_replace(name, "rn", "m"), "vv", "w")


def _alike(names: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct names that are one edit apart or look the same to a scanner."""
    by_looks = pairs_within(names.select("name", _looks("name").alias("looks")), ["looks"], "name")
    return near(names, "name", [], "name", shortest=5).select("a", "b").unionByName(by_looks).distinct()


def _gives_way(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(a, b, nb) for spelling a giving way to b: b is clearly more frequent or, if both are rare, comes first. It's a
    strict order, so following it ends. pairs: (a, b); counts: (name, n)."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = both.join(counts.select(F.col("name").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("name").alias("b"), F.col("n").alias("nb")), "b")
    rare = F.col("na") <= 2
    return both.where((F.col("nb") >= F.col("na") * 3) | ((F.col("nb") > F.col("na")) & rare) | ((F.col("na") == F.col("nb")) & rare & (F.col("b") < F.col("a")))).select("a", "b", "nb")


def _followed(to: DataFrame, keys: list[str]) -> DataFrame:
    """to (keys, a, b) with each b replaced by what it gives way to in the end, keys alike: every round looks up where
    the other end has come, so chains of any length are followed in as many rounds as their length has binary digits."""
    while True:
        step = to.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"))
        to = cut(to.join(step, [*keys, "b"], "left").select(*keys, "a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")))
        moved = to.where("moved").limit(1).count()
        to = to.drop("moved")
        if not moved:
            return to


def _towns(t: DataFrame) -> DataFrame:
    """(town, usual) of spellings of towns that give way to another."""
    towns = t.select(F.explode("readings").alias("r")).where(F.col("r.town").isNotNull() & (F.size("readings") == 1)).groupBy(F.col("r.town").alias("name")).agg(F.count("*").alias("n"))
    towns = cut(towns)
    first = Window.partitionBy("a").orderBy(F.desc("nb"), "b")
    to = _gives_way(_alike(towns), towns).withColumn("k", F.row_number().over(first)).where("k = 1").select(F.lit(0).alias("all"), "a", "b")
    return cut(towns.join(_followed(cut(to), ["all"]).select(F.col("a").alias("name"), F.col("b").alias("usual")), "name", "left").select(F.col("name").alias("town"), F.coalesce("usual", "name").alias("usual"), "n"))


def _read_one_way(t: DataFrame, towns: DataFrame) -> DataFrame:
    """t with name and town in place of readings. Of several readings the one whose name is a typed street's counts
    first, then one whose town is known, then one without a town, then the longest name."""
    typed = t.where(F.col("type").isNotNull()).select(F.element_at("readings", 1)["name"].alias("name"), F.lit(4).alias("street")).distinct()
    known = towns.select("town", "usual", F.lit(2).alias("locality"))
    r = t.select("address_id", F.explode("readings").alias("r")).select("address_id", "r.name", "r.town").join(typed, "name", "left").join(known, "town", "left")
    worth = F.coalesce("street", F.lit(0)) + F.coalesce("locality", F.when(F.col("town").isNull(), 1).otherwise(0))
    best = r.groupBy("address_id").agg(F.max(F.struct(worth, F.length("name"), "name", F.coalesce("usual", "town").alias("town"))).alias("r"))
    return t.drop("readings").join(best.select("address_id", "r.name", "r.town"), "address_id")


def _street_names(t: DataFrame) -> DataFrame:
    """(name, town, usual) of the spellings in a town (empty where none is known) that give way to another. One that
    occurs in the same town is preferred. Names of two to four letters are compared where they share a house number;
    numbered streets and single letters only equal themselves."""
    lettered = t.where(~F.col("name").rlike(r"^\d") & (F.length("name") > 1))
    names = cut(lettered.groupBy("name").agg(F.count("*").alias("n")))
    places = cut(lettered.groupBy("name", F.coalesce("town", F.lit("")).alias("town")).agg(F.count("*").alias("there")))
    at = lettered.where((F.length("name") <= 5) & F.col("number").isNotNull()).select("name", "number").distinct().withColumn("key", F.concat_ws("|", "name", "number"))
    name_of = lambda c: F.substring_index(c, "|", 1)
    short = near(at, "key", ["number"], "name", shortest=2).select(name_of("a").alias("a"), name_of("b").alias("b")).where(F.least(F.length("a"), F.length("b")) < 5)
    better = cut(_gives_way(_alike(names).unionByName(short.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), names))
    here = better.join(places.select(F.col("name").alias("a"), "town"), "a")
    here = here.join(places.select(F.col("name").alias("b"), "town", "there"), ["b", "town"], "left")
    best = Window.partitionBy("a", "town").orderBy(F.coalesce(F.when(F.col("town") != "", F.col("there")), F.lit(0)).desc(), F.desc("nb"), "b")
    first = here.withColumn("k", F.row_number().over(best)).where("k = 1").select("town", "a", "b")
    # what a spelling gives way to may itself not occur in the town; it then follows its way without a town
    anywhere = better.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("nb"), "b"))).where("k = 1").select("a", F.col("b").alias("c"))
    ends = first.select("town", F.col("b").alias("a")).join(first.select("town", "a"), ["town", "a"], "left_anti").join(anywhere, "a").select("town", "a", F.col("c").alias("b")).distinct()
    return _followed(cut(first.unionByName(ends)), ["town"]).select(F.col("a").alias("name"), "town", F.col("b").alias("usual"))


def _typed(t: DataFrame) -> DataFrame:
    """t with the type of each street, its own or inherited, and candidates: the streets that a record without a type
    may lie on, as 'direction name type', empty where its type is known or no street of its name has one."""
    held = cut(t.where(F.col("type").isNotNull()).select("name", F.col("direction").alias("d"), "type", "town").distinct())
    postal = t.where(F.col("postal").isNotNull() & F.col("town").isNotNull()).select("postal", F.col("town").alias("near")).distinct()
    open_ = t.where(F.col("type").isNull()).select("name", "direction", "town", "postal").distinct()
    inherited = open_.where(F.col("town").isNull()).join(postal, "postal", "left").unionByName(open_.where(F.col("town").isNotNull()).withColumn("near", F.col("town")))
    keys = ["name", "direction", "o_town", "postal"]
    met = inherited.withColumnRenamed("town", "o_town").join(held, "name")
    same_way, same_town = F.col("d").eqNullSafe(F.col("direction")), F.col("town") == F.col("near")
    street = F.struct(F.col("d"), F.col("type"))
    met = met.groupBy(*keys).agg(
        F.collect_set(F.when(same_way & same_town, street)).alias("c1"), F.collect_set(F.when(same_way, street)).alias("c2"), F.collect_set(F.when(same_town, street)).alias("c3"), F.collect_set(street).alias("c4")
    )
    chosen = F.when(F.size("c1") > 0, F.col("c1")).when(F.size("c2") > 0, F.col("c2")).when(F.size("c3") > 0, F.col("c3")).otherwise(F.col("c4"))
    met = met.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.array_sort(chosen).alias("c")).withColumn("types", F.array_distinct(F.transform("c", lambda x: x["type"])))
    on = [F.col(k).eqNullSafe(F.col(f"k_{n}")) for k, n in (("name", "name"), ("direction", "direction"), ("town", "o_town"), ("postal", "postal"))]
    t = t.join(met, [*on, F.col("type").isNull()], "left")
    listed = F.when(F.size("types") > 1, F.transform("c", lambda x: F.concat_ws(" ", x["d"], F.col("name"), x["type"])))
    only = F.when(F.size("types") == 1, F.element_at("types", 1))
    return t.withColumn("candidates", F.coalesce(listed, F.array().cast("array<string>"))).withColumn("type", F.coalesce("type", only)).drop(*[f"k_{k}" for k in keys], "c", "types")


def resolved(addresses: DataFrame) -> DataFrame:
    """(address_id, postal, town, name, direction, type, number, unit, candidates, level) of each record that names a
    street: its levels in their usual spelling, the candidates that are left where the street is ambiguous, and the
    deepest level that is settled: unit, number, street, or locality where the street is open."""
    schema = "address_id long, " + ", ".join(f"{f} string" for f in FIELDS) + ", readings array<struct<name:string,town:string>>"
    t = cut(addresses.select(F.col("address_id").cast("long"), "address").mapInArrow(_parse, schema))
    t = cut(_read_one_way(t, _towns(t)))
    usual = _street_names(t).withColumnRenamed("town", "t")
    t = t.join(usual, (t["name"] == usual["name"]) & (F.coalesce(t["town"], F.lit("")) == F.col("t")), "left").select("address_id", *FIELDS, "town", F.coalesce("usual", t["name"]).alias("name"))
    t = _typed(cut(t))
    level = F.when(F.size("candidates") > 0, "locality").when(F.col("number").isNull(), "street").when(F.col("unit").isNull(), "number").otherwise("unit")
    return t.select("address_id", "postal", "town", "name", "direction", "type", "number", "unit", "candidates", level.alias("level"))


def same_building(addresses: DataFrame) -> DataFrame:
    """Pairs (address_id_a, address_id_b), smaller first, of records with the same number on the same street."""
    r = resolved(addresses).where(F.col("level").isin("number", "unit"))
    r = cut(r.select("address_id", "number", "name", F.coalesce("direction", F.lit("")).alias("direction"), F.coalesce("type", F.lit("")).alias("type")))
    met = pairs_within(r, ["number", "name", "direction", "type"], "address_id")
    return met.select(F.col("a").alias("address_id_a"), F.col("b").alias("address_id_b"))
