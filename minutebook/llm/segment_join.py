"""Strings within a small edit distance, by the pigeonhole principle, and the classes that links make."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutebook.session import cut, free


def within(a: str, b: str, k: int) -> bool:
    """Whether at most k insertions, deletions, substitutions or exchanges of neighbours turn a into b; only the band
    of k cells on each side of the diagonal is filled in."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return False
    if a == b:
        return True
    far = k + 1
    before: dict[int, int] = {}
    row = {j: j for j in range(min(m, k) + 1)}
    for i in range(1, n + 1):
        new = {}
        for j in range(max(0, i - k), min(m, i + k) + 1):
            if j == 0:
                new[j] = i
                continue
            same = a[i - 1] == b[j - 1]
            best = min(row.get(j - 1, far) + (not same), row.get(j, far) + 1, new.get(j - 1, far) + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, before.get(j - 2, far) + 1)
            new[j] = best
        if min(new.values()) > k:
            return False
        before, row = row, new
    return row.get(m, far) <= k


def typing_slip(a: str, b: str) -> bool:
    """Whether two strings within two edits differ as hands slip: one of the edits doubles a letter or drops one of a
    double, or exchanges neighbours."""
    single = [re.sub(r"(.)\1+", r"\1", x) for x in (a, b)]
    if a != b and (single[0] == single[1] or single != [a, b] and within(*single, 1) and not within(a, b, 1)):
        return True
    if sorted(a) == sorted(b) and a != b:
        return True
    for i in range(min(len(a), len(b)) - 1):  # an exchange and one edit more
        if a[i] != b[i] or (a[i] == b[i] and a[i + 1] != b[i + 1]):
            for k in (i, i + 1):
                if k + 1 < len(a) and a[k] != a[k + 1] and within(a[:k] + a[k + 1] + a[k] + a[k + 2 :], b, 1) and not within(a, b, 1):
                    return True
            break
    return False


def _verify(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [within(a, b, k) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_())).rename_columns(["a", "b", "x", "y"])

    return run


def _segment(value: Column, size: Column, i: Column, parts: int, shift: Column | int = 0) -> Column:
    """Segment i of `parts` of a string of this size, which differ by one in length at most, read at a shift from
    value; null where it is empty or begins outside."""
    lo, hi = F.floor(size * i / parts).cast("int"), F.floor(size * (i + 1) / parts).cast("int")
    at = lo + 1 + shift
    return F.when((at >= 1) & (hi > lo), F.substring(value, at, hi - lo))


def near(df: DataFrame, key: str, block: list[str], value: str, k: int = 1, shortest: int = 4) -> DataFrame:
    """Pairs (a, b, x, y) of keys, a < b, with their values, which differ by 1 to k edits (also exchanges of neighbours)
    and whose block columns are equal.

    k edits touch at most 2k segments, an exchange two. So each value is cut into 2k + 1 segments, of which one is
    whole in any value within k edits, shifted by k at most: an inverted index on (block, size, number, segment) is
    looked up with the shifted substrings. Values under `shortest` characters match nothing. keys are distinct; null
    values and keys are left out.
    """
    parts = 2 * k + 1
    t = df.where(F.col(value).isNotNull() & F.col(key).isNotNull() & (F.length(value) >= shortest)).select(F.col(key).alias("k"), F.col(value).alias("v"), *block)
    size, v = F.length("v"), F.col("v")
    hashed = lambda length, i, part: F.when(part.isNotNull(), F.xxhash64(*block, length, i, part))
    span = lambda a, b: F.sequence(F.lit(a), F.lit(b))
    # lambdas over numbers keep the plan small whatever k is
    index = F.transform(span(0, parts - 1), lambda i: F.xxhash64(*block, size, i, F.coalesce(_segment(v, size, i, parts), F.lit(""))))
    probes = F.transform(span(0, k), lambda less: F.transform(span(0, parts - 1), lambda i: F.transform(span(-k, k), lambda shift: hashed(size - less, i, _segment(v, size - less, i, parts, shift)))))
    left = t.select("k", "v", F.explode(F.array_distinct(index)).alias("h"))
    right = t.select(F.col("k").alias("k2"), F.col("v").alias("v2"), F.explode(F.array_compact(F.array_distinct(F.flatten(F.flatten(probes))))).alias("h"))
    # both sides are many times their table, which the size estimate doesn't see: neither may be gathered for a broadcast
    met = left.hint("merge").join(right, "h").where((F.length("v") < F.length("v2")) | ((F.length("v") == F.length("v2")) & (F.col("k") < F.col("k2"))))
    met = met.where(F.col("v") != F.col("v2")).select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"), F.when(F.col("k") < F.col("k2"), F.col("v")).otherwise(F.col("v2")).alias("x"), F.when(F.col("k") < F.col("k2"), F.col("v2")).otherwise(F.col("v")).alias("y")).distinct()
    kind = df.schema[key].dataType.simpleString()
    return met.mapInArrow(_verify(k), f"a {kind}, b {kind}, x string, y string")


def pairs_within(df: DataFrame, keys: list[str], name: str, group: int = 2000) -> DataFrame:
    """(a, b), a < b, of the values of column `name` in rows with equal keys; null keys pair with nothing, and a value
    that occurs twice counts once. A class of more than `group` rows is cut into that many parts on one side, which meet
    copies of the other side, so that no task holds a whole large class."""
    t = df.select(*keys, name).distinct()
    big = t.groupBy(*keys).agg(F.ceil(F.count("*") / group).cast("int").alias("parts")).where("parts > 1")
    t = t.join(big, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    x = t.select(*keys, F.col(name).alias("a"), F.pmod(F.xxhash64(name), F.col("parts")).cast("int").alias("part"))
    y = t.select(*keys, F.col(name).alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return x.join(y, [*keys, "part"]).where(F.col("a") < F.col("b")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b): root is the least node that links lead to.

    Alternates large and small stars: every node tells its larger neighbours, then its smaller ones, of the least it
    knows, which at least halves long chains; each round is written to the shared folder, until one changes nothing.
    Nothing is gathered.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct())
    was = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        new = cut(small.where(F.col("u") != F.col("v")).distinct())
        now = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        free(edges)
        edges = new
        if now == was:
            break
        was = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
