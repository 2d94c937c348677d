"""Mixing sources to target shares of all tokens (problem 9).

The mix is a curriculum over training time t in [0, 1]. Each source has a weight schedule, piecewise linear over time;
its integral up to t, scaled to 1 at the end, times the source's demand is the number of tokens asked of it so far. A
document takes the stretch of its source's cumulative tokens that it fills, and its position is the time at which
demand reaches the middle of that stretch. Sorting by position gives the training order, in which every source keeps
to its schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minutebook.session import cut

#: Cumulative tokens are summed within hash buckets of about this many documents, then over the buckets of a source.
BUCKET_ROWS = 100_000
EXACT = "exact"


def laid_out(sized: DataFrame, key: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, source, tokens, before): before is the number of tokens of the source's documents that come earlier in a
    random but fixed order. Documents of no tokens are left out. A source is cut into as many buckets as its number of
    documents asks for, so that no task sees more than a bucket of documents or the totals of a source's buckets."""
    docs = sized.where(F.col("tokens") > 0).withColumn("h", F.xxhash64(F.col(key), F.lit("order")))
    parts = docs.groupBy("source").agg(F.ceil(F.count("*") / bucket_rows).alias("parts"))
    docs = docs.join(parts, "source").withColumn("bucket", F.pmod("h", F.col("parts"))).drop("parts")
    totals = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("own"))
    over = Window.partitionBy("source").orderBy("bucket")
    totals = totals.withColumn("offset", F.sum("own").over(over) - F.col("own")).drop("own")
    within = Window.partitionBy("source", "bucket").orderBy("h", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = docs.withColumn("running", F.sum("tokens").over(within) - F.col("tokens"))
    return docs.join(totals, ["source", "bucket"]).select(key, "source", "tokens", (F.col("offset") + F.col("running")).alias("before"))


def demands(sized: DataFrame, targets: DataFrame, total: int | str | None = None) -> DataFrame:
    """One row a source of targets: (source, target_share, max_repeats, held, wanted, demand). held is the tokens of
    its documents, wanted its share of the total, demand what the mix takes of it: wanted, but at most max_repeats
    times what it holds. total is

    - None: the tokens that the sources of targets hold together, so that the mix is as large as its sources;
    - a number of tokens;
    - EXACT: the largest total at which no source is asked for more than its capped repeats. Every source then has its
      share to the nearest document, but one tiny source makes the whole mix small, and what the others hold beyond
      it is left out. Sources that hold nothing are then left out too, and the others share the total in proportion."""
    held = sized.groupBy("source").agg(F.sum("tokens").alias("held"))
    once = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    once = once.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = once.join(held, "source", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    sums = t.where(F.col("held") > 0).agg(
        F.sum("held").alias("all_held"), F.sum("target_share").alias("shares"), F.min(F.col("held") * F.col("max_repeats") / F.col("target_share")).alias("feasible")
    )
    t = t.crossJoin(F.broadcast(sums))  # one row
    if total == EXACT:
        wanted = F.when(F.col("held") > 0, F.col("target_share") * F.col("feasible")).otherwise(0.0)
    else:
        wanted = F.col("target_share") * (F.col("all_held") if total is None else F.lit(float(total)))
    t = t.withColumn("wanted", F.coalesce(wanted, F.lit(0.0)))
    most = (F.col("held") * F.col("max_repeats")).cast("double")
    return t.select("source", "target_share", "max_repeats", "held", "wanted", F.least("wanted", most).alias("demand"))


def leaning(want: DataFrame) -> DataFrame:
    """The schedule of sources that are given none: (source, at, weight), linear, with more weight late in training the
    fuller a source's repeats are used, so that repeats lie far apart from the first pass."""
    most = F.col("held") * F.col("max_repeats")
    tilt = F.when(most > 0, F.col("demand") / most - 0.5).otherwise(0.0)
    ends = F.array(F.struct(F.lit(0.0).alias("at"), (1 - tilt).alias("weight")), F.struct(F.lit(1.0).alias("at"), (1 + tilt).alias("weight")))
    return want.select("source", F.explode(ends).alias("k")).select("source", "k.at", "k.weight")


def integrals(schedule: DataFrame) -> DataFrame:
    """(source, knots) of a schedule (source, at, weight): its knots in order of time as (at, weight, part), part the
    integral of the weight up to there over the whole integral. Knots outside [0, 1], of negative or null weight, are
    left out; of several at one time the greatest weight counts; the first and last weights hold out to 0 and 1. A
    schedule of no weight counts as even."""
    s = schedule.where(F.col("source").isNotNull() & F.col("at").between(0, 1) & (F.col("weight") >= 0))
    s = s.groupBy("source", F.col("at").cast("double").alias("at")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
    ends = s.groupBy("source").agg(F.min_by("weight", "at").alias("first"), F.max_by("weight", "at").alias("last"))
    s = s.unionByName(ends.select("source", F.lit(0.0).alias("at"), F.col("first").alias("weight"))).unionByName(ends.select("source", F.lit(1.0).alias("at"), F.col("last").alias("weight")))
    whole, order = Window.partitionBy("source"), Window.partitionBy("source").orderBy("at")
    s = s.distinct().withColumn("weight", F.when(F.max("weight").over(whole) > 0, F.col("weight")).otherwise(1.0))
    area = (F.col("at") - F.lag("at").over(order)) * (F.col("weight") + F.lag("weight").over(order)) / 2
    s = s.withColumn("area", F.coalesce(area, F.lit(0.0)))
    s = s.withColumn("part", F.sum("area").over(order) / F.sum("area").over(whole))
    return s.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("at", "weight", "part"))).alias("knots"))


def reached(part: Column, knots: Column) -> Column:
    """The time at which a schedule has asked for this part of its demand: within the stretch between two knots that
    holds it, the root of the integral of a line."""
    stretches = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: F.struct(knots[i - 1].alias("a"), knots[i].alias("b")))
    of = F.element_at(F.filter(stretches, lambda s: (s["b"]["part"] >= part) & (s["b"]["part"] > s["a"]["part"])), 1)
    a, b = of["a"], of["b"]
    span, inner = b["at"] - a["at"], (part - a["part"]) / (b["part"] - a["part"])
    mean = (a["weight"] + b["weight"]) / 2
    start, slope = a["weight"] / mean, (b["weight"] - a["weight"]) / mean / 2
    root = (F.sqrt(F.greatest(start * start + 4 * slope * inner, F.lit(0.0))) - start) / (2 * slope)
    return F.coalesce(a["at"] + span * F.when(F.abs(slope) < 1e-9, inner).otherwise(root), F.lit(1.0))


def mixed(sized: DataFrame, targets: DataFrame, key: str = "doc_id", total: int | str | None = None, schedule: DataFrame | None = None) -> DataFrame:
    """(key, source, repeat, tokens, position): every occurrence of a document in the mix, repeat from 1 on; no
    document occurs more than its source's max_repeats times. A source's documents are taken in a fixed random order,
    pass after pass, until its demand is met to the nearest document. Order by position, then key, to train.

    sized: (key, source, tokens); null sources and documents of no tokens are never drawn. A source that holds too
    little for its share of the total gives all its capped repeats, and shares() shows what it lacks; total as in
    demands(). schedule: (source, at, weight), the relative weight of a source at knots of time; sources that it lacks
    follow leaning()."""
    want = demands(sized, targets, total).where(F.col("demand") > 0)
    knots = integrals(leaning(want))
    if schedule is not None:
        own = integrals(schedule)
        knots = own.unionByName(knots.join(own.select("source"), "source", "left_anti"))
    want = cut(want.join(knots, "source"))  # a row a source
    docs = laid_out(sized.where(F.col("source").isNotNull()), key).join(want, "source")
    middle = F.col("before") + F.col("tokens") / 2
    passes = F.least(F.floor((F.col("demand") - middle) / F.col("held")) + 1, F.col("max_repeats").cast("long"))
    docs = docs.withColumn("passes", passes.cast("int")).where(F.col("passes") > 0)
    drawn = docs.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    part = (F.col("before") + F.col("tokens") / 2 + (F.col("repeat") - 1) * F.col("held")) / F.col("demand")
    return drawn.select(key, "source", "repeat", "tokens", reached(F.least(part, F.lit(1.0)), F.col("knots")).alias("position"))


def in_order(mix: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix in training order: range-partitioned by position and sorted, without one sorting task."""
    return mix.orderBy("position", key, "repeat")


def shares(mix: DataFrame, want: DataFrame) -> DataFrame:
    """(source, target_share, wanted, tokens, lacking, actual_share, occurrences, most_repeats, capped) of each source
    in want, as demands() gives it: wanted is its share of the total, lacking what it falls short of that because all
    its repeats are used, actual_share its part of the tokens that are in the mix."""
    own = mix.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("occurrences"), F.max("repeat").alias("most_repeats"))
    all_tokens = own.agg(F.sum("tokens").alias("all"))
    t = want.join(own, "source", "left").crossJoin(F.broadcast(all_tokens))  # one row
    tokens = F.coalesce("tokens", F.lit(0))
    return t.select(
        "source", "target_share", F.round("wanted").cast("long").alias("wanted"), tokens.alias("tokens"), F.round(F.col("wanted") - F.col("demand")).cast("long").alias("lacking"),
        F.coalesce(tokens / F.col("all"), F.lit(0.0)).alias("actual_share"), F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        (F.col("demand") < F.col("wanted")).alias("capped"),
    )
