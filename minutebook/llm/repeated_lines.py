"""Lines repeated across the documents of a kind (problem 7).

Lines are parsed into a token tree of fixed depth: the number of words, then the first words, of which those with
digits are a wildcard. Within a leaf a template keeps the words that enough documents of the kind have at their place;
every other word is an open slot. Counts of paths and of words at places are sums, so the trees of partitions merge by
aggregation, and leaves that cover too few documents are left before words are counted. A template that covers enough
documents is repeated; without an open slot it is a repeated line, since each word of such a line is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutebook.session import cut

WORD = r"[\p{L}\p{N}]+"
DEPTH = 4


def words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))


def _slot(w: Column) -> Column:
    return F.when(w.rlike(r"\p{N}"), F.lit("*")).otherwise(w)


def parsed(pages: DataFrame, depth: int = DEPTH, least_words: int = 5) -> DataFrame:
    """(document_id, page_id, line_no, leaf, line): leaf is a hash of the tree path, line the sequence of words. Lines
    with fewer than `least_words` words of letters alone are left out, as are null and empty pages."""
    lines = pages.where(F.col("content").isNotNull()).select("document_id", F.col("id").alias("page_id"), F.posexplode(F.split("content", "\n")).alias("line_no", "text"))
    lines = lines.where(F.length("text") >= 2 * least_words - 1)

    def keyed(w: Column) -> Column:
        counts = F.size(F.filter(w, lambda x: x.rlike(r"^\p{L}+$"))) >= least_words
        path = F.xxhash64(F.size(w), F.transform(F.slice(w, 1, depth), _slot))
        return F.when(counts, F.struct(path.alias("leaf"), F.concat_ws(" ", w).alias("line")))

    lines = lines.withColumn("k", F.element_at(F.transform(F.array(words(F.col("text"))), keyed), 1)).where(F.col("k").isNotNull())
    return lines.select("document_id", "page_id", "line_no", F.col("k.leaf").alias("leaf"), F.col("k.line").alias("line"))


def kinds(documents: DataFrame) -> DataFrame:
    """(document_id, kind), once each. A null kind is a kind of its own."""
    return documents.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("document_id")).agg(F.max(F.coalesce("kind", F.lit(""))).alias("kind"))


def covering(lines: DataFrame, keys: list[str], totals: DataFrame, least_documents: int, share: float) -> DataFrame:
    """(kind, keys, documents) of what occurs in enough documents of the kind. For a kind there are at most as many of
    them as an average document holds, over the share."""
    docs = lines.select("kind", "document_id", *keys).distinct().groupBy("kind", *keys).agg(F.count("*").alias("documents"))
    enough = (F.col("documents") >= least_documents) & (F.col("documents") >= F.col("total") * F.lit(share) - 1e-9)
    return docs.join(totals, "kind").where(enough).select("kind", *keys, "documents")


def lines_of(pages: DataFrame, documents: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(lines, totals): the parsed lines of all pages with their kind, written once, and the documents of each kind.
    Pages of unknown documents are left out; pages that arrive twice count once."""
    of = cut(kinds(documents))
    return cut(parsed(pages, depth).join(of, "document_id")), of.groupBy("kind").agg(F.count("*").alias("total"))


#: Rows of leaves, kept words or templates up to which they are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def templates(lines: DataFrame, totals: DataFrame, least_documents: int = 3, share: float = 0.08, slots: float = 0.0) -> DataFrame:
    """(kind, document_id, page_id, line_no, template, slots, documents): the lines whose template occurs in at least
    `least_documents` documents and in at least `share` of all documents of its kind, and has at most the given part of
    its words open; 0 takes repeated lines alone. Open slots are written *."""
    leaves = _small(covering(lines, ["leaf"], totals, least_documents, share).select("kind", "leaf"))
    some = cut(lines.join(leaves, ["kind", "leaf"], "left_semi").distinct())
    words_at = some.select("kind", "document_id", "leaf", F.posexplode(F.split("line", " ")).alias("at", "word"))
    kept = covering(words_at, ["leaf", "at", "word"], totals, least_documents, share)
    kept = _small(kept.groupBy("kind", "leaf").agg(F.collect_set(F.concat("at", F.lit(" "), "word")).alias("kept")))
    word = lambda x, i: F.when(F.array_contains("kept", F.concat(i.cast("string"), F.lit(" "), x)), x).otherwise("*")
    some = some.join(kept, ["kind", "leaf"]).withColumn("w", F.transform(F.split("line", " "), word)).drop("kept", "leaf", "line")
    some = some.withColumn("slots", F.size(F.filter("w", lambda x: x == "*"))).where(F.col("slots") <= F.size("w") * F.lit(float(slots)))
    some = cut(some.withColumn("template", F.concat_ws(" ", "w")).drop("w"))
    often = _small(covering(some, ["template"], totals, least_documents, share))
    return some.join(often, ["kind", "template"]).select("kind", "document_id", "page_id", "line_no", "template", "slots", "documents")


def repeated(pages: DataFrame, documents: DataFrame, least_documents: int = 3, share: float = 0.08, depth: int = DEPTH, slots: float = 0.0) -> DataFrame:
    """(kind, document_id, page_id, line_no, documents): each occurrence of a repeated line, or with `slots` of a
    repeated template."""
    lines, totals = lines_of(pages, documents, depth)
    return templates(lines, totals, least_documents, share, slots).select("kind", "document_id", "page_id", "line_no", "documents")


def without_repeated(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, content, removed): each page once, without its repeated lines. Null content stays null."""
    gone = found.groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    once = pages.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("page_id")).agg(F.max("content").alias("content"))
    joined = once.join(gone, "page_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.filter(F.split("content", "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i))
    return joined.select("page_id", F.when(F.size("gone") == 0, F.col("content")).otherwise(F.array_join(kept, "\n")).alias("content"), F.size("gone").alias("removed"))
