"""Members, recorded positions and the aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minutebook.functions.text import name_key

POSITIONS = ("aye", "no", "absent", "excused")


def aliases(supervisors: DataFrame) -> DataFrame:
    """(supervisor_id, alias, normalized_alias, confidence): display name, family name where one member has it, and
    slug, each normalized alias once, the surer member's."""
    alone = supervisors.groupBy("family_name").agg(F.count("*").alias("n")).where("n = 1").select("family_name")
    rows = supervisors.select("id", F.col("display_name").alias("alias"), F.lit(1.0).alias("c")).unionByName(supervisors.join(alone, "family_name", "left_semi").select("id", F.col("family_name").alias("alias"), F.lit(0.9).alias("c")))
    rows = rows.unionByName(supervisors.select("id", F.col("slug").alias("alias"), F.lit(0.8).alias("c")))
    best = rows.withColumn("k", name_key(F.col("alias"))).groupBy("k").agg(F.max(F.struct("c", -F.col("id"), "alias", "id")).alias("r"))
    return best.select(F.col("r.id").alias("supervisor_id"), "r.alias", F.col("k").alias("normalized_alias"), F.col("r.c").alias("confidence"))


def positions(roll_calls: DataFrame) -> DataFrame:
    """(roll_call_id, item_id, sequence, action_type, is_final, position, recorded_name), each once. Copies are put
    together by roll call, before there is a row for each name."""
    arrays = ("ayes", "noes", "absent", "excused")
    keys = ["roll_call_id", "item_id", "sequence", "action_type", "is_final"]
    calls = roll_calls.withColumnRenamed("id", "roll_call_id").groupBy(*keys).agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in arrays])
    tagged = F.array(*[F.struct(F.lit(p).alias("position"), F.col(c).alias("names")) for p, c in zip(POSITIONS, arrays)])
    return calls.select(*keys, F.explode(tagged).alias("t")).select(*keys, "t.position", F.explode("t.names").alias("recorded_name"))


def reconciled(positions: DataFrame, dated: DataFrame, supervisors: DataFrame) -> DataFrame:
    """positions with the columns of dated, supervisor_id and confidence. dated: (item_id, meeting_date) and others. A
    family name in office on the day, of the latest term, decides at 0.98; else an alias at its confidence; else nobody
    at 0.5. What a name may mean is one row with the terms of the few members who share it, so positions are read and
    joined once."""
    p = positions.join(dated, "item_id", "left").withColumn("k", name_key(F.col("recorded_name")))
    s = supervisors.select(name_key(F.col("family_name")).alias("k"), F.struct("term_start", (-F.col("id")).alias("first"), F.col("id").alias("sid"), "term_end").alias("t"))
    terms = s.where(F.col("k").isNotNull()).groupBy("k").agg(F.collect_list("t").alias("terms"))
    a = aliases(supervisors).select(F.col("normalized_alias").alias("k"), F.col("supervisor_id").alias("by_alias"), "confidence")
    known = terms.join(a, "k", "full")
    day = F.col("meeting_date")
    in_office = lambda t: day.isNotNull() & (t["term_start"].isNull() | (day >= t["term_start"])) & (t["term_end"].isNull() | (day <= t["term_end"]))
    out = p.join(known, "k", "left").withColumn("by_term", F.array_max(F.filter("terms", in_office))["sid"])
    sure = F.when(F.col("by_term").isNotNull(), 0.98).when(F.col("by_alias").isNotNull(), F.col("confidence")).otherwise(0.5)
    return out.select(*positions.columns, *[c for c in dated.columns if c != "item_id"], F.coalesce("by_term", "by_alias").alias("supervisor_id"), sure.cast("decimal(4,3)").alias("confidence"))


def resolve(supervisors: DataFrame, voter: str) -> DataFrame:
    """(supervisor_id, via): the member that a name means: by alias, else by slug."""
    key = name_key(F.lit(voter))
    a = aliases(supervisors).where(F.col("normalized_alias") == key).select("supervisor_id", F.lit("alias").alias("via"), F.lit(1).alias("rank"))
    s = supervisors.where(F.lower("slug") == voter.lower()).select(F.col("id").alias("supervisor_id"), F.lit("slug").alias("via"), F.lit(2).alias("rank"))
    return a.unionByName(s).orderBy("rank", "supervisor_id").limit(1).drop("rank")


def latest_votes(votes: DataFrame, group: Column) -> DataFrame:
    """The newest row of each group: by meeting date, roll-call sequence and id."""
    by = Window.partitionBy("_g").orderBy(F.desc("meeting_date"), F.desc("sequence"), F.desc("roll_call_id"))
    return votes.withColumn("_g", group).withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_g", "_k")


def histogram(rows: DataFrame, column: str = "position") -> DataFrame:
    """One row with a count for each of the four positions, 0 where there is none."""
    return rows.agg(*[F.count_if(F.col(column) == p).alias(p) for p in POSITIONS])


def housing(rows: DataFrame) -> DataFrame:
    """One row: files with and without a unit count, the sum of each file's greatest, and the sorted addresses.
    rows: (units array<long>, addresses array<string>)."""
    most = F.array_max("units")
    return rows.agg(F.count_if(most.isNotNull()).alias("known"), F.count_if(most.isNull()).alias("unknown"), F.coalesce(F.sum(most), F.lit(0)).alias("units"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("addresses")))).alias("addresses"))


def member_list(supervisors: DataFrame, votes: DataFrame) -> DataFrame:
    """Members with first and last recorded date and number of positions, those without votes included; sitting ones
    first, by district number, then by name."""
    v = votes.where(F.col("supervisor_id").isNotNull()).groupBy("supervisor_id").agg(F.min("meeting_date").alias("first_vote"), F.max("meeting_date").alias("last_vote"), F.count("*").alias("positions"))
    m = supervisors.join(v, supervisors["id"] == v["supervisor_id"], "left")
    number = F.when(F.col("active") & F.col("district").rlike(r"^\d+$"), F.col("district").try_cast("int"))
    return m.select(F.col("id").alias("supervisor_id"), "display_name", "active", "district", "first_vote", "last_vote", F.coalesce("positions", F.lit(0)).alias("positions")).orderBy(F.desc("active"), number.asc_nulls_last(), "family_name", "display_name", "supervisor_id")
