"""Variant spellings of typed names (problem 2).

Names are read as persons, with a given name (the slot) and a family name (the core), or as organisations, with their
words. Spellings of persons link where given names are equal and family names within one edit, two in long ones, or
the other way round; where both parts are misspelled; where given names are short forms of one another, by a table or
by the families in which both occur; and where an initial or no given name leaves only one person of that family name.
Organisations meet in their rarest words and link where their words agree in any order up to abbreviations, acronyms
and words of kind that one of them leaves out. The segment join finds all that is near.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minutebook.llm.segment_join import components, near, pairs_within, typing_slip, within
from minutebook.session import cut

# Words and abbreviations of typed names.
TITLES = set("supervisor supervisors sup supv president chair chairman chairwoman chairperson vice mr mrs ms miss mx dr rev hon prof sir madam commissioner director mayor councilmember".split())
PARTICLES = set("de la del las los da das do dos di du le van von der den st".split())
PLACEHOLDERS = set("speaker speakers male female unidentified unknown unnamed anonymous public member of the caller name inaudible person citizen resident man woman voice not given none na no".split())
FUNCTION_WORDS = set("the of for and a an at in on by".split())
#: Nouns that say what kind of organisation one is; common abbreviations that say that it is one.
KINDS = set("""agency alliance association authority bakery bank bureau center church club coalition collective college commission committee company cooperative corporation council department district
federation foundation fund group hospital hotel institute league library ministry museum network office organization parish partners partnership project school services society store team temple theater trust union university""".split())
#: Words that many organisations have in their names; abbreviations of them and of KINDS are known by rule.
COMMON = set("""arts brothers business children citizens city civic commerce community construction county cultural democratic design development economic education employees engineers enterprises environmental family friends
general hardware health heritage historical home homeowners housing improvement industries international labor legal local management medical merchants national neighborhood neighborhoods neighbors owners parents pacific
planning properties public recreation residents senior seniors services small social sons state street students teachers tenants trade transit united veterans women workers youth""".split())
ABBREVIATED = set("assn assoc cncl co corp dept fdn inc llc llp ltd org".split())
#: Short forms of given names, the full name first.
SHORT_FORMS = """
abigail abby gail|andrew andy drew|anthony tony|beatrice bea|benjamin ben benny|catherine cathy kate|katherine kathy kate|kathleen kathy kate|charles charlie chuck|christopher chris kit|christine chris tina|
consuelo chelo|daniel dan danny|david dave|deborah deb debbie|dolores lola|dorothy dot dottie|edgar ed eddie|edward ed eddie ted ned|elizabeth liz beth betty eliza|eugene gene|florence flo|frances fran frankie|
francisco paco pancho|frederick fred freddie|gerald gerry jerry|gregory greg|guadalupe lupe|harold harry hal|henry hank harry|ignacio nacho|isabel bel bella|james jim jimmy|jennifer jen jenny|john jack johnny|joseph joe joey|
jose pepe|joshua josh|kenneth ken kenny|lawrence larry|leonard len lenny|margaret peggy maggie meg|matthew matt|michael mike mick|nancy nan|nicholas nick|pamela pam|patricia pat patty|peter pete|philip phil|raymond ray|
rebecca becky|richard rick dick rich|robert bob rob bobby|ronald ron|samuel sam sammy|stephen steve|steven steve|susan sue|theodore ted theo|theresa terry tess|thomas tom tommy|timothy tim|victoria vicky|virginia ginny|walter walt|william bill will billy|winifred winnie freddie|zachary zach
"""


def short_forms(table: str = SHORT_FORMS) -> dict[str, list[str]]:
    """Short form to the names it may stand for, of a table as SHORT_FORMS."""
    out: dict[str, list[str]] = {}
    for group in table.replace("\n", "").split("|"):
        formal, *short = group.split()
        for s in short:
            out.setdefault(s, []).append(formal)
    return out


_LOOKS = str.maketrans("015|", "olsl")


def fold(word: str) -> str:
    """Letters and digits in lower case, without accents; digits that scans put for letters are read as those: 0 o, 1 l, 5 s."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).casefold()
    if not plain.strip().isdigit():
        plain = plain.translate(_LOOKS)
    return re.sub(r"[^\w]|_", "", plain)


def _organisation(raw: list[str], shouted: bool) -> list[str] | None:
    """The words of an organisation, in order, or None if the name isn't one. It is one if it has a noun of kind, also
    misspelled, or an abbreviation of one, two words that many organisations have, or among other words an acronym of
    three to five capitals."""
    words = [w for x in raw if x != "," and (w := re.sub(r"[^\w]|_", "", unicodedata.normalize("NFKD", re.sub(r"['’]s?$", "", x)).casefold()))]
    words = [w for w in words if w not in FUNCTION_WORDS]
    capitals = [x for x in raw if re.fullmatch(r"[A-Z]{3,5}", x) and not re.fullmatch(r"[IVXL]+", x)]
    named = any(w in KINDS or w in ABBREVIATED or (len(w) >= 6 and any(abs(len(w) - len(k)) < 2 and within(w, k, 1) for k in KINDS)) for w in words)
    named = named or sum(w in COMMON for w in words) > 1
    return words if len(words) > 1 and (named or (capitals and not shouted)) else None


def _abbreviates(short: str, long: str) -> bool:
    """Letters of the longer word in order, from its first on, that begin it or end as it ends."""
    if len(short) < (2 if long in KINDS else 3) or len(long) < len(short) + 2 or short[0] != long[0]:
        return False
    rest = iter(long)
    return all(c in rest for c in short) and (long.startswith(short) or short[-1] == long[-1])


def _misspells(a: str, b: str) -> bool:
    """One edit in words of four letters and more, or two in long ones if they are slips of typing."""
    return min(len(a), len(b)) >= 4 and not (a.isdigit() or b.isdigit()) and (within(a, b, 1) or min(len(a), len(b)) >= LONG and within(a, b, 2) and typing_slip(a, b))


@lru_cache(maxsize=1 << 16)
def tells(w: str) -> bool:
    """Whether a word may tell organisations apart: none of those that many have, no spelling of one, no number."""
    if w.isdigit() or w in KINDS or w in COMMON or w in ABBREVIATED:
        return False
    return not any(_abbreviates(w, k) or len(w) >= 6 and within(w, k, 1) for k in (*KINDS, *COMMON))


def same_organisation(a: list[str], b: list[str], often_a: list[int], often_b: list[int]) -> bool:
    """Whether two organisations' words agree in any order. The rarest telling word of each, by how often its words
    occur, must be in the other, up to spelling; of the other words one side may have an abbreviation or an acronym, and
    one side may lack words of kind."""
    left, right = list(a), list(b)

    def acronyms(one: list[str], other: list[str]) -> None:
        for x in [x for x in one if 3 <= len(x) <= 6 and x not in other]:
            at = next((k for k in range(len(other) - len(x) + 1) if "".join(y[0] for y in other[k : k + len(x)]) == x), None)
            if at is not None:
                one.remove(x)
                del other[at : at + len(x)]

    acronyms(left, right)
    acronyms(right, left)
    cores = set()
    for own, words, often in ((left, a, often_a), (right, b, often_b)):
        told = [(n, w) for w, n in zip(words, often) if w in own and tells(w)] or [(n, w) for w, n in zip(words, often) if w in own]
        cores |= {min(told)[1]} if told else set()
    certain: set[str] = set()
    for match in (str.__eq__, _misspells, lambda x, y: not cores & {x, y} and (_abbreviates(x, y) or _abbreviates(y, x))):
        for x in list(left):
            y = next((y for y in right if match(x, y)), None)
            if y is not None:
                certain |= {x, y}
                left.remove(x)
                right.remove(y)
    return bool(cores) and cores <= certain and not (left and right) and not any(w.isdigit() or tells(w) for w in left + right)


def read(name: str | None) -> tuple[str, str, str, str] | None:
    """(kind, slot, core, form): kind p for a person, or o for an organisation, whose core is its words; form is comma or plain for a person with two parts, whose order only the
    other names tell if plain, else empty. None where the name denotes nobody."""
    if name is None or not name.strip():
        return None
    inside = re.findall(r"\(([^)]*)\)", name)
    bare = re.sub(r"\([^)]*\)", " ", name)
    raw = [x for x in re.split(r"[\s/]+", re.sub(r"#\s*(?=\d)", " ", bare.replace("&", " and ").replace(",", " , "))) if x]
    words = [f for x in raw if x != "," and (f := fold(x))]
    if not words or all(w in map_fold(PLACEHOLDERS) for w in words):
        return None
    shouted = name.upper() == name
    org = _organisation(raw, shouted)
    if org is not None:
        org += [w for part in inside for x in part.split() if (w := fold(x)) and w not in FUNCTION_WORDS]
    if org is not None:
        return "o", "", " ".join(org), ""
    while len(raw) > 1 and fold(raw[0]) in map_fold(TITLES):
        raw = raw[1:]
    if "," in raw:
        at = raw.index(",")
        family, given = raw[:at], [x for x in raw[at + 1 :] if x != ","]
        core, first = "".join(map(fold, family)), (fold(given[0]) if given else "")
        return ("p", first, core, "comma" if len(first) > 1 else "") if core else None
    cased = not (name.isupper() or name.islower())
    parts: list[str] = []
    for x in raw:  # a piece in lower case belongs to the word before it
        if cased and parts and x[0].islower() and fold(x) not in PARTICLES:
            parts[-1] += x
        else:
            parts.append(x)
    folded = [fold(x) for x in parts]
    folded = [x for x in folded if x]
    if not folded:
        return None
    if len(folded) == 1:
        return "p", "", folded[0], ""
    if len(folded[-1]) == 1:
        return "p", folded[-1], "".join(folded[:-1]), ""
    second_particle = folded[1] in PARTICLES
    if folded[0] in PARTICLES or (second_particle and len(folded[0]) <= 1 and "." not in parts[0]):
        return "p", "", "".join(folded), ""
    given, rest = folded[0], folded[1:]
    while len(rest) > 1 and len(rest[0]) == 1:  # initials between
        rest = rest[1:]
    plain = "plain" if len(rest) == 1 and len(given) > 1 else ""
    return "p", given, "".join(rest), plain


_folded: dict[int, set[str]] = {}


def map_fold(words: set[str]) -> set[str]:
    if id(words) not in _folded:
        _folded[id(words)] = {fold(w) for w in words}
    return _folded[id(words)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, out = batch.column(0).to_pylist(), []
        for n in names:
            r = read(n)
            if r is not None:
                out.append((n, *r))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["name", "kind", "slot", "core", "form"])


def _formals(table: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(node, core, x) for node, core, slot in zip(*(batch.column(i).to_pylist() for i in range(3))) for x in {slot, *map(fold, table.get(slot, []))}]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["node", "core", "formal"])

    return run


#: Family names from this length on may have two edits; given names that one in this many uses of another is a slip of.
LONG, RARE = 9, 0.1
#: How likely chance alone may bring a short form together with any other given name as often as the families show it.
CHANCE = 0.05


def parsed(names: DataFrame) -> DataFrame:
    """(name, n, kind, slot, core) of distinct names that denote somebody, n how often one occurs. Of two plain words
    the one that other names use more often as a given name is the given name."""
    counted = names.where(F.col("name").isNotNull()).groupBy("name").agg((F.sum("n") if "n" in names.columns else F.count("*")).alias("n"))
    counted = cut(counted)
    t = cut(counted.select("name").mapInArrow(_parse, "name string, kind string, slot string, core string, form string").join(counted, "name"))
    two = t.where((F.col("kind") == "p") & (F.col("form") != ""))
    given = two.select(F.col("slot").alias("word"), F.lit(1).alias("n")).unionByName(two.select(F.col("core").alias("word"), F.lit(-1).alias("n")))
    given = given.groupBy("word").agg(F.sum("n").alias("given"))
    plain = t.where(F.col("form") == "plain")
    plain = plain.join(given.select(F.col("word").alias("slot"), F.col("given").alias("g1")), "slot").join(given.select(F.col("word").alias("core"), F.col("given").alias("g2")), "core")
    turn = (F.col("g2") > F.col("g1")) & (F.col("g2") > 0)
    turned = plain.select("name", "n", "kind", F.when(turn, F.col("core")).otherwise(F.col("slot")).alias("slot"), F.when(turn, F.col("slot")).otherwise(F.col("core")).alias("core"))
    return turned.unionByName(t.where(F.col("form") != "plain").select("name", "n", "kind", "slot", "core"))


def _slips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slip = [typing_slip(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slip, pa.bool_())], [*batch.schema.names, "slip"])


def _corrected(people: DataFrame) -> DataFrame:
    """(slot, usual) of given names that are one edit from another and rare beside it, so slips of it; Juan and Joan
    are two names where both are in use. The most used of several is taken."""
    used = cut(people.groupBy("slot").agg(F.count("*").alias("used")))
    pairs = near(used, "slot", [], "slot", shortest=3).select("a", "b")
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of = lambda side: used.select(F.col("slot").alias(side), F.col("used").alias(f"used_{side}"))
    pairs = pairs.join(of("a"), "a").join(of("b"), "b")
    rare = (F.col("used_a") <= F.greatest(F.lit(1), F.col("used_b") * RARE)) & ((F.col("used_a") < F.col("used_b")) | (F.col("b") < F.col("a")))
    return pairs.where(rare).groupBy(F.col("a").alias("slot")).agg(F.max_by("b", F.struct("used_b", "b")).alias("usual"))


def _beyond_chance(both: Column, families: Column, sizes: Column, share: Column, trials: Column) -> Column:
    """Whether a name is in `both` of the `families` of another more often than by chance, sizes (size, k) being theirs:
    k families of that many given names, each of which may be any other family's with the given share. The bound is
    Chernoff's, for the average of the families."""
    one_in = F.aggregate(sizes, F.lit(0.0), lambda total, x: total + x["k"] * (1 - F.pow(1 - share, x["size"] - 1))) / families
    least = F.lit(1e-12)
    p, met = F.least(F.greatest(one_in, least), 1 - least), both / families
    bound = both * F.log(met / p) + (families - both) * F.log(F.greatest(1 - met, least) / (1 - p))
    return (met > p) & (bound >= F.log(F.greatest(trials, F.lit(1)) / CHANCE))


def _short_for(people: DataFrame) -> DataFrame:
    """(slot, formal) of given names that the names themselves show to be short for another: most families that have
    the one have the other too, in three families at least, or in one if the short form begins or ends the other, and
    more often than chance brings them together in families of such sizes.

    All families count. A name that is in most families of another, three at least, is in one of any of them that are
    one more than it may miss, so candidates are looked up in the smallest of them alone; other candidates share their
    first or last three letters."""
    slots = cut(people.select("core", "slot").distinct())
    of = cut(slots.join(slots.groupBy("core").agg(F.count("*").alias("size")), "core"))
    sizes = of.groupBy("slot", "size").agg(F.count("*").alias("k")).groupBy("slot")
    used = cut(sizes.agg(F.sum("k").alias("families"), F.sum(F.col("k") * F.col("size")).alias("near"), F.collect_list(F.struct("size", "k")).alias("sizes")))
    every = used.agg(F.coalesce(F.sum("families"), F.lit(0)).alias("rows"), F.count_if(F.col("families") >= 3).alias("names"))

    counted = of.join(used.select("slot", "families").where("families >= 3"), "slot")
    may_miss = F.col("families") - F.greatest(F.lit(3), F.ceil(F.col("families") / 2))
    seeds = counted.withColumn("at", F.row_number().over(Window.partitionBy("slot").orderBy("size", "core"))).where(F.col("at") <= may_miss + 1)
    often = counted.select("core", F.col("slot").alias("formal"), F.col("families").alias("of_formal"))
    met = seeds.hint("merge").join(often, "core").where((F.col("slot") != F.col("formal")) & (F.col("of_formal") >= F.col("families"))).select("slot", "formal")
    ends = F.explode(F.array(F.concat(F.lit("b"), F.substring("slot", 1, 3)), F.concat(F.lit("e"), F.substring("slot", -3, 3))))
    keyed = slots.where(F.length("slot") >= 3).select("core", "slot", ends.alias("end"))
    begins = (F.col("formal").startswith(F.col("slot")) | F.col("formal").endswith(F.col("slot"))) & (F.length("slot") >= 3)
    alike = keyed.hint("merge").join(keyed.withColumnRenamed("slot", "formal"), ["core", "end"]).where((F.col("slot") != F.col("formal")) & begins).select("slot", "formal")
    pairs = cut(met.unionByName(alike).distinct())

    both = pairs.hint("merge").join(slots, "slot").join(slots.withColumnRenamed("slot", "formal"), ["core", "formal"], "left_semi").groupBy("slot", "formal").agg(F.count("*").alias("both"))
    of_formal = used.select(F.col("slot").alias("formal"), F.col("families").alias("of_formal"))
    found = both.join(used, "slot").join(of_formal, "formal").crossJoin(F.broadcast(every))  # one row
    found = found.where((F.col("both") * 2 >= F.col("families")) & (F.col("of_formal") >= F.col("families")) & ((F.col("both") >= 3) | begins))
    share = F.least(F.lit(1.0), (F.col("of_formal") - F.col("both")) / F.greatest(F.col("rows") - F.col("near"), F.lit(1)))
    return found.where(_beyond_chance(F.col("both"), F.col("families"), F.col("sizes"), share, F.when(begins, 1).otherwise(F.col("names") - 1))).select("slot", "formal")


#: A word in so many organisations' names tells none of them apart.
WIDESPREAD = 30


def _telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([tells(w) for w in batch.column(0).to_pylist()], pa.bool_())], ["w", "df", "told"])


def _organisations(nodes: DataFrame) -> DataFrame:
    """(node, words, often, keys) of organisations: their words, how many have each, and the three rarest telling ones.
    A person's node whose family name is an acronym of organisations' words counts as one too."""
    own = nodes.where("kind = 'o'").select("node", F.split("core", " ").alias("words"))
    initials = own.select(F.transform("words", lambda w: F.substring(w, 1, 1)).alias("i"))
    runs = F.transform(F.sequence(F.lit(1), F.size("i")), lambda k: F.transform(F.array(*[F.lit(n) for n in (3, 4, 5)]), lambda n: F.when(k + n - 1 <= F.size("i"), F.array_join(F.slice("i", k, n), ""))))
    acronyms = initials.select(F.explode(F.array_compact(F.flatten(runs))).alias("core")).distinct()
    lettered = nodes.where((F.col("kind") == "p") & (F.length("slot") > 1)).join(acronyms, "core", "left_semi").select("node", F.array("slot", "core").alias("words"))
    every = cut(own.unionByName(lettered))

    words = every.select("node", F.posexplode("words").alias("at", "w"))
    often = words.select("node", "w").distinct().groupBy("w").agg(F.count("*").cast("int").alias("df"))
    told = often.mapInArrow(_telling, "w string, df int, told boolean").withColumn("told", F.col("told") & (F.col("df") < WIDESPREAD))
    ranked = words.join(told, "w").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("at", "w", "df"))).alias("all"), F.array_sort(F.collect_set(F.when(F.col("told"), F.struct("df", "w")))).alias("told"), F.array_sort(F.collect_set(F.struct("df", "w"))).alias("any")
    )
    rarest = F.slice(F.when(F.size("told") > 0, F.col("told")).otherwise(F.col("any")), 1, 3)
    return cut(ranked.select("node", F.transform("all", lambda x: x["w"]).alias("words"), F.transform("all", lambda x: x["df"]).alias("often"), F.transform(rarest, lambda x: x["w"]).alias("keys")))


def _agreeing(keyed: DataFrame, keys: DataFrame, nearby: DataFrame) -> DataFrame:
    """Links (a, b) of organisations that meet in a key, (node, w), or in two that are nearby, (a, b), and whose words
    agree."""
    same = pairs_within(keys, ["w"], "node")
    across = cut(nearby).join(keys.select(F.col("w").alias("a"), F.col("node").alias("m")), "a").join(keys.select(F.col("w").alias("b"), F.col("node").alias("n")), "b")
    across = across.where(F.col("m") != F.col("n")).select(F.least("m", "n").alias("a"), F.greatest("m", "n").alias("b"))
    met = cut(same.unionByName(across).distinct())
    of = lambda side: keyed.select(F.col("node").alias(side), F.col("words").alias(f"w_{side}"), F.col("often").alias(f"o_{side}"))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("w_a", "w_b", "o_a", "o_b")]
            keep = [same_organisation(*row) for row in zip(*cols)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.join(of("a"), "a").join(of("b"), "b").mapInArrow(agree, "a string, b string")


def _attach(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return cut(nodes.join(roots.select(F.col("node").alias("n2"), "root"), nodes["node"] == F.col("n2"), "left").select("node", "kind", "slot", "core", F.coalesce("root", "node").alias("root")))


def _near_links(nodes: DataFrame, people: DataFrame) -> DataFrame:
    """Links (a, b) of all nodes whose spellings are near. Persons are compared by family name among those whose given
    name is the same up to slips, organisations by their rarest words: one join finds one edit, one two edits in long
    words, for both."""
    usual = nodes.where("kind = 'p'").join(_corrected(people), "slot", "left").select("node", "core", "n", F.coalesce("usual", "slot").alias("slot"))
    usual = cut(usual)
    keyed = _organisations(nodes)
    keys = cut(keyed.select("node", F.explode("keys").alias("w")))
    row = lambda kind, name, block, value: (F.concat(F.lit(kind), F.col(name)).alias("key"), F.concat(F.lit(kind), block).alias("block"), F.col(value).alias("v"))
    rows = cut(usual.select(*row("p", "node", F.col("slot"), "core")).unionByName(keys.select("w").distinct().select(*row("o", "w", F.lit(""), "w"))))
    found = near(rows, "key", ["block"], "v", 1, shortest=2).unionByName(near(rows, "key", ["block"], "v", 2, shortest=LONG)).distinct()
    found = cut(found.mapInArrow(_slips, "a string, b string, x string, y string, slip boolean").withColumn("one", F.levenshtein("x", "y") <= 1).withColumn("short", F.least(F.length("x"), F.length("y")) < 5))

    plain = lambda kind: found.where(F.col("a").startswith(kind)).withColumns({c: F.substring(c, 2, 1 << 30) for c in ("a", "b")})
    of = lambda side: usual.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"))
    # in short names and with two edits, one must be a slip of typing or occur four times as often as the other
    persons = plain("p").join(of("a"), "a").join(of("b"), "b")
    persons = persons.where((F.col("one") | _exchanged("x", "y")) & ~F.col("short") | F.col("slip") | (F.greatest("n_a", "n_b") >= 4 * F.least("n_a", "n_b"))).select("a", "b")
    alike = usual.select("node", "slot", F.regexp_replace(F.regexp_replace("core", "rn", "m"), "vv", "w").alias("looks"))  # what scans confuse
    words = plain("o").where(~F.col("short") & (F.col("one") | F.col("slip"))).select("a", "b")
    # several small plans: the driver holds each in full, once more for every stage that ends
    return cut(persons).unionByName(cut(pairs_within(alike, ["slot", "looks"], "node"))).unionByName(cut(_agreeing(keyed, keys, words)))


def _exchanged(x: str, y: str) -> Column:
    """Whether two strings of equal letters differ by two places, as an exchange of neighbours makes them."""
    letters = lambda c: F.array_sort(F.split(c, ""))
    return (letters(x) == letters(y)) & (F.levenshtein(x, y) <= 2)


def _formal_names(people: DataFrame, short: dict[str, list[str]]) -> DataFrame:
    """(node, core, formal): the names that the given name of a person may stand for, itself included."""
    formal = people.select("node", "core", "slot").mapInArrow(_formals(short), "node string, core string, formal string")
    learned = people.join(_short_for(people), "slot").select("node", "core", "formal")
    return cut(formal.unionByName(learned).distinct())


def linked(names: DataFrame, short: dict[str, list[str]] | None = None) -> DataFrame:
    """(name, entity) of the distinct names that denote somebody; entity is a key that the spellings of one person or
    organisation share. names: (name) or (name, n), n how often it occurs. short: given names' short forms, as
    short_forms() gives them."""
    t = cut(parsed(names).withColumn("node", F.concat_ws("|", "kind", "slot", "core")))
    nodes = cut(t.groupBy("node", "kind", "slot", "core").agg(F.sum("n").alias("n")))
    people = cut(nodes.where((F.col("kind") == "p") & (F.length("slot") > 1)))
    formal = _formal_names(people, short_forms() if short is None else short)
    edges = cut(_near_links(nodes, people).unionByName(cut(pairs_within(formal, ["core", "formal"], "node"))).distinct())
    once = _attach(nodes, components(edges))

    spelled = once.where((F.col("kind") == "p") & (F.length("slot") > 1)).select("node", "core", "root")
    first = formal.select("node", F.substring("formal", 1, 1).alias("first")).distinct()
    spelled = cut(spelled.join(first, "node").select("core", "root", "first").distinct())
    only = lambda keys: spelled.groupBy(*keys).agg(F.countDistinct("root").alias("n"), F.min("root").alias("a")).where("n = 1").select(*keys, "a")
    initial = once.where((F.col("kind") == "p") & (F.length("slot") == 1)).select("node", "core", F.col("slot").alias("first"), "root")
    nameless = once.where((F.col("kind") == "p") & (F.col("slot") == "")).select("node", "core", "root")
    more = initial.join(only(["core", "first"]), ["core", "first"]).select("a", F.col("root").alias("b"))
    more = more.unionByName(nameless.join(only(["core"]), "core").select("a", F.col("root").alias("b")))
    # an initial is all that is known of some; their names without one are theirs if there is one initial only
    lone = initial.join(spelled.select("core").distinct(), "core", "left_anti").groupBy("core").agg(F.countDistinct("first").alias("n"), F.min("root").alias("a")).where("n = 1")
    more = more.unionByName(nameless.join(lone, "core").select("a", F.col("root").alias("b")))
    again = components(cut(more.distinct()))
    final = once.join(again.select(F.col("node").alias("r2"), F.col("root").alias("top")), once["root"] == F.col("r2"), "left").select("node", F.coalesce("top", "root").alias("entity"))
    return t.join(final, "node").select("name", "entity")


def spelling_pairs(names: DataFrame) -> DataFrame:
    """All pairs (name_a, name_b), name_a < name_b by code point, of different spellings of one entity."""
    return pairs_within(cut(linked(names)), ["entity"], "name").select(F.col("a").alias("name_a"), F.col("b").alias("name_b"))


def typed_names(roll_calls: DataFrame, comments: DataFrame) -> DataFrame:
    """(name, n): the names of ayes, noes and speakers, and how often each occurs."""
    none = F.array().cast("array<string>")
    votes = roll_calls.select(F.explode(F.concat(F.coalesce("ayes", none), F.coalesce("noes", none))).alias("name"))
    every = votes.unionByName(comments.select(F.col("speaker").alias("name"))).where(F.col("name").isNotNull() & (F.trim("name") != ""))
    return every.groupBy("name").agg(F.count("*").alias("n"))
