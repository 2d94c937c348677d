"""Near-duplicate texts by MinHash banding (problem 1).

Exact copies (of the normalised words) are first folded into classes, so a text that arrives a million times is
signed, banded and compared once. Representatives are signed with MinHash, cut into bands, and meet where a band
agrees; each meeting is verified on the full sets of word n-grams. Only the result is expanded to pairs of items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutebook.llm.segment_join import components, pairs_within
from minutebook.llm.text import ascii_words
from minutebook.session import cut


def band_plan(threshold: float, recall: float = 0.999, hashes: int = 160) -> tuple[int, int]:
    """Bands and rows: the most rows a band can have so that a pair at the threshold still meets in a band with the
    given probability, within a number of hash functions. More rows mean fewer meetings of unlike texts."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)) if threshold < 1 else 1, 1)
    for rows in range(2, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def shingles(words: Column, n: int) -> Column:
    """Distinct runs of n consecutive words as 64-bit hashes, from words with one space between them. Fewer than n
    words give an empty array."""
    def runs(w: Column) -> Column:
        last = F.size(w) - F.lit(n - 1)
        at = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
        some = F.array_distinct(F.transform(at, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(n)])))
        return F.when(last >= 1, some).otherwise(F.array().cast("array<bigint>"))

    # the outer transform binds the split words once; written in place, every run would split the text again
    once = F.transform(F.array(F.split(words, " ")), runs)
    return F.when(words != "", F.element_at(once, 1)).otherwise(F.array().cast("array<bigint>"))


def _banded(bands: int, rows: int, seed: int):
    """Arrow batches of (id, grams) to (id, size, band hashes)."""
    rng = np.random.default_rng(seed)
    k = bands * rows
    a = rng.integers(1, 1 << 32, k, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, k, dtype=np.uint64)
    mix = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            grams = batch.column("grams")
            flat = grams.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = grams.offsets.to_numpy() - grams.offsets[0].as_py()
            out = np.empty((len(batch), bands), dtype=np.uint64)
            for i in range(len(batch)):
                g = flat[at[i] : at[i + 1]]
                low = np.full(k, np.iinfo(np.uint64).max, dtype=np.uint64)
                for lo in range(0, len(g), 4096):  # a very long text needs no more memory than this many runs
                    part = g[lo : lo + 4096, None]
                    h = part * a + b
                    h ^= h >> np.uint64(29)
                    h *= np.uint64(0xBF58476D1CE4E5B9)
                    np.minimum(low, (h >> np.uint64(1)).min(axis=0), out=low)
                out[i] = ((low.reshape(bands, rows) * mix).sum(axis=1, dtype=np.uint64) + numbers) * np.uint64(0xD6E8FEB86659FD93)
            bands_col = pa.ListArray.from_arrays(np.arange(0, len(batch) * bands + 1, bands, dtype=np.int32), pa.array(out.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("size"), bands_col], ["rep", "size", "bands"])

    return sign


def classes(items: DataFrame, key: str, words: Column) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep, size) and texts (rep, words): rep is the smallest key with the same words, size the number of
    words. Texts are folded on the map side, and only hashes travel with the members, so a text that a third of the
    rows share is as good as any other."""
    t = items.select(F.col(key).alias("id"), words.alias("words")).withColumn("print", F.sha2("words", 256))
    texts = t.groupBy("print").agg(F.min("id").alias("rep"), F.first("words").alias("words"))
    texts = cut(texts)
    slim = t.select("id", "print", F.size(F.split("words", " ")).alias("size")).distinct()
    return slim.join(texts.select("print", "rep"), "print").select("id", "rep", "size"), texts.select("rep", "words")


def similar(
    texts: DataFrame, threshold: float, n: int = 5, recall: float = 0.999, hashes: int = 160, seed: int = 7
) -> DataFrame:
    """Pairs (a, b, jaccard), a < b, of distinct texts whose runs of n words overlap by the threshold.

    texts: (rep, words), rep distinct. Texts of fewer than n words have no run and are in no pair. A meeting of two
    texts of which one has too few runs for the threshold is dropped at once; no bucket has a cap.
    """
    bands, rows = band_plan(threshold, recall, hashes)
    grams = cut(texts.select("rep", shingles(F.col("words"), n).alias("grams")).where(F.size("grams") > 0).withColumn("size", F.size("grams")))
    signed = grams.mapInArrow(_banded(bands, rows, seed), "rep long, size int, bands array<long>")
    meet = signed.select("rep", "size", F.explode("bands").alias("band"))
    left, right = meet.select(F.col("rep").alias("a"), F.col("size").alias("size_a"), "band"), meet.select(F.col("rep").alias("b"), F.col("size").alias("size_b"), "band")
    near = (F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * threshold) & (F.col("a") < F.col("b"))
    pairs = left.join(right, "band").where(near).select("a", "b").distinct()
    of = lambda side: grams.select(F.col("rep").alias(side), F.col("grams").alias(f"grams_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    both = both.select("a", "b", shared.alias("shared"), (F.size("grams_a") + F.size("grams_b") - shared).alias("either"))
    return both.where(F.col("shared") >= F.col("either") * F.lit(threshold) - 1e-9).select("a", "b", (F.col("shared") / F.col("either")).alias("jaccard"))


def item_words(items: DataFrame) -> DataFrame:
    """Items with content: (id, words) of title and content; a null title counts as empty."""
    return items.where(F.col("content").isNotNull() & (F.col("content") != "") & F.col("id").isNotNull()).select(
        "id", ascii_words(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("content"))).alias("words")
    )


def item_matches(items: DataFrame, threshold: float, n: int, recall: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """(members, links): members is (id, rep, size), links the similar pairs of representatives."""
    members, texts = classes(item_words(items), "id", F.col("words"))
    return cut(members), similar(texts, threshold, n, recall)


def item_pairs(items: DataFrame, threshold: float = 0.7, n: int = 3, recall: float = 0.999) -> DataFrame:
    """All pairs of different items, smaller id first, also those of equal words. Items that share their words but have
    fewer than n of them share no run and make no pair."""
    members, links = item_matches(items, threshold, n, recall)
    slim = members.select("id", "rep")
    copies = pairs_within(members.where(F.col("size") >= n), ["rep"], "id")
    across = links.join(slim.select(F.col("id").alias("x"), F.col("rep").alias("a")), "a").join(slim.select(F.col("id").alias("y"), F.col("rep").alias("b")), "b")
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return copies.unionByName(across).select(F.col("a").alias("item_id_a"), F.col("b").alias("item_id_b"))


def item_groups(items: DataFrame, threshold: float = 0.7, n: int = 3, recall: float = 0.999) -> DataFrame:
    """One row an item with content: (item_id, class_id, group_id, copies, links, members). class_id is the least item
    of equal words and copies the number of these, links the number of other classes that are similar to it; group_id
    is the least item that a chain of similar classes leads to, members the number of items of its group. A third of
    all items in one group is as good as any: no pairs within classes are made."""
    members, links = item_matches(items, threshold, n, recall)
    links = cut(links.select("a", "b"))
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    roots = components(links).select(F.col("node").alias("rep"), F.col("root").alias("group_id"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies")).join(ends, "rep", "left").join(roots, "rep", "left")
    sizes = cut(sizes.select("rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "rep").alias("group_id")))
    whole = sizes.groupBy("group_id").agg(F.sum("copies").alias("members"))
    return members.select("id", "rep").join(sizes.join(whole, "group_id"), "rep").select(F.col("id").alias("item_id"), F.col("rep").alias("class_id"), "group_id", "copies", "links", "members")
