"""Names of members in running text: which names to look for, and whom each denotes on a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutebook.functions.text import short_name

#: Characters beside which a name is part of a longer word or an address.
JOINED = r"[\p{L}\p{N}@._-]"


def name_links(supervisors: DataFrame, aliases: DataFrame) -> DataFrame:
    """(supervisor_id, slug, active, term_start, term_end, names): the distinct names of each member: display name, its
    first and last word if it has more than two, family name, then aliases, the longest first. Empty names are left out."""
    listed = aliases.where(F.col("alias").isNotNull()).groupBy("supervisor_id").agg(F.array_sort(F.collect_set(F.struct((-F.length("alias")).alias("l"), "alias"))).alias("a"))
    s = supervisors.join(listed, supervisors["id"] == listed["supervisor_id"], "left")
    others = F.coalesce(F.transform("a", lambda x: x["alias"]), F.array().cast("array<string>"))
    names = F.concat(F.array(F.col("display_name"), short_name(F.col("display_name")), F.col("family_name")), others)
    return s.select(F.col("id").alias("supervisor_id"), "slug", "active", "term_start", "term_end", F.filter(F.array_distinct(F.array_compact(names)), lambda x: x != "").alias("names"))


def priority(active: Column, term_start: Column, term_end: Column, day: Column, this_year: int) -> Column:
    """How likely a member is meant on a day: 3 in the term, 0 outside one that is known, 2 for one who sits, in the
    last two years, else 1."""
    known = term_start.isNotNull() & term_end.isNotNull()
    return F.when(known, F.when(day.between(term_start, term_end), 3).otherwise(0)).when(active & (F.year(day) >= this_year - 2), 2).otherwise(1)


def _pattern(names: list[str]) -> str:
    """One expression for all names, the longest first, not within a longer word."""
    escaped = ["".join(f"\\{c}" if c in r".*+?^${}()|[]\\-#&~" else c for c in n) for n in sorted(set(names), key=lambda n: (-len(n), n))]
    return f"(?iu)(?<!{JOINED})({'|'.join(escaped)})(?!{JOINED})"


def linked(texts: DataFrame, key: str, text: str, day: str, links: DataFrame, this_year: int) -> DataFrame:
    """(key, at, name, slug): the names of members in each text, in order, at the nth place (from 1), with the member
    who is likeliest on the day of the text; of equally likely ones the last by slug. A name that begins in lower case, or
    stands before a full stop as addresses do, is none. links: name_links(), a table of members, whose names make one expression of the plan."""
    every = links.select(F.explode("names").alias("name")).distinct().collect()  # the names of the members
    if not every:
        return texts.select(key, F.lit(0).alias("at"), F.lit("").alias("name"), F.lit("").alias("slug")).where("false")
    found = texts.select(key, day, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(_pattern([r.name for r in every])), F.lit(1))).alias("at", "name"))
    first = F.regexp_extract("name", r"(\p{L})", 1)
    found = found.where((first == "") | (first == F.upper(first))).withColumn("at", F.col("at") + 1)
    of = links.select("slug", "active", "term_start", "term_end", F.explode("names").alias("_n")).withColumn("_k", F.lower("_n"))
    days = found.select(F.lower("name").alias("_k"), F.col(day).alias("_day")).distinct().join(F.broadcast(of), "_k")  # the members
    likely = F.struct(priority(F.col("active"), F.col("term_start"), F.col("term_end"), F.col("_day"), this_year), F.col("slug"))
    who = days.groupBy("_k", "_day").agg(F.max_by("slug", likely).alias("slug"))
    return found.join(who, (F.lower("name") == F.col("_k")) & F.col(day).eqNullSafe(F.col("_day"))).select(key, "at", "name", "slug")


#: The fields that a contact must have.
CONTACT = ("address", "email", "phone", "website", "aides")


def contact(metadata: Column, fields: tuple[str, ...] = CONTACT) -> Column:
    """The contact in a member's metadata as a map, or null unless each of its fields is text that isn't empty."""
    c = F.from_json(F.get_json_object(metadata, "$.contact"), "map<string,string>")
    whole = None
    for f in fields:
        one = F.coalesce(F.trim(F.try_element_at(c, F.lit(f))) != "", F.lit(False))
        whole = one if whole is None else whole & one
    return F.when(whole, c)


def district(stored: Column, slug: Column, curated: dict[str, str]) -> Column:
    """The stored district without leading zeros, else the curated one of the member's slug."""
    known = F.create_map(*[F.lit(x) for pair in curated.items() for x in pair]) if curated else F.create_map().cast("map<string,string>")
    return F.coalesce(F.when(stored.rlike(r"^\d+$"), F.regexp_replace(stored, r"^0+(?=\d)", "")).otherwise(F.nullif(F.trim(stored), F.lit(""))), F.try_element_at(known, slug))
