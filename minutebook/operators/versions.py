"""Content hashes, versions, sparse page archives and diffs of documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ABSENT = "absent"


def document_hashes(pages: DataFrame) -> DataFrame:
    """(document_id, content_sha256, page_count): the hash of the pages in order, each as number, newline and content,
    with form feeds between. Pages that arrive twice count once; null content counts as empty."""
    once = pages.groupBy("document_id", "page_number").agg(F.max(F.coalesce("content", F.lit(""))).alias("content"))
    listed = once.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "content"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: F.concat(x["page_number"].cast("string"), F.lit("\n"), x["content"])), "\f")
    return listed.select("document_id", F.sha2(whole, 256).alias("content_sha256"), F.size("p").alias("page_count"))


def append_versions(known: DataFrame, hashes: DataFrame) -> DataFrame:
    """(document_id, version_number, content_sha256, page_count, change_type) of documents whose hash is not known:
    the next number after the greatest, `create` for a document's first version and else `update`."""
    top = known.groupBy("document_id").agg(F.max("version_number").alias("top"))
    new = hashes.join(known.select("document_id", "content_sha256"), ["document_id", "content_sha256"], "left_anti").join(top, "document_id", "left")
    by = Window.partitionBy("document_id").orderBy("content_sha256")
    number = (F.coalesce("top", F.lit(0)) + F.row_number().over(by)).cast("int")
    return new.select("document_id", number.alias("version_number"), "content_sha256", "page_count", F.when(number == 1, "create").otherwise("update").alias("change_type"))


def archive(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, page_number, content, content_sha256): the pages of the old state that the new one changes, a page
    that the old one lacks with the hash `absent`. Both sides: (document_id, page_number, content)."""
    both = old.withColumnRenamed("content", "was").withColumn("had", F.lit(True)).join(new.withColumnRenamed("content", "now").withColumn("has", F.lit(True)), ["document_id", "page_number"], "full")
    both = both.where(~F.col("was").eqNullSafe(F.col("now")) | F.col("had").isNull() | F.col("has").isNull())
    return both.select("document_id", "page_number", F.coalesce("was", F.lit("")).alias("content"), F.when(F.col("had").isNull(), ABSENT).otherwise(F.sha2(F.coalesce("was", F.lit("")), 256)).alias("content_sha256"))


def reconstructed(current: DataFrame, archives: DataFrame, versions: DataFrame) -> DataFrame:
    """(document_id, version_number, page_number, content) of each version. archives: (document_id, version_number,
    page_number, content, content_sha256), where the archive of version n holds what n + 1 changed. A page of version n
    is that of the oldest archive from n on that holds it, else the current one; so overlays chain from the newest."""
    pages = current.select("document_id", "page_number").union(archives.select("document_id", "page_number")).distinct()
    grid = versions.select("document_id", "version_number").join(pages, "document_id")
    a = archives.select("document_id", "page_number", F.col("version_number").alias("held"), F.col("content").alias("old"), "content_sha256")
    over = grid.join(a, ["document_id", "page_number"], "left").where(F.col("held").isNull() | (F.col("held") >= F.col("version_number")))
    first = over.groupBy("document_id", "version_number", "page_number").agg(F.min(F.struct("held", "old", "content_sha256")).alias("o"))
    whole = grid.join(first, ["document_id", "version_number", "page_number"], "left").join(current.select("document_id", "page_number", F.col("content").alias("now")), ["document_id", "page_number"], "left")
    held = F.col("o.held").isNotNull()
    gone = F.when(held, F.col("o.content_sha256") == ABSENT).otherwise(F.col("now").isNull())
    return whole.where(~gone).select("document_id", "version_number", "page_number", F.when(held, F.col("o.old")).otherwise(F.col("now")).alias("content"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(document_id, page_number, change): added, removed or modified pages by sha256; a page that reverted to the same
    text is no change. Both sides: (document_id, page_number, content)."""
    h = lambda df, name: df.select("document_id", "page_number", F.sha2(F.coalesce("content", F.lit("")), 256).alias(name))
    both = h(before, "x").join(h(after, "y"), ["document_id", "page_number"], "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.select("document_id", "page_number", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("modified").alias("change"))


def line_diff_of(old: str | None, new: str | None, most: int = 100) -> dict:
    """The lines between the common beginning and end, at most 100 a side."""
    a, b = (old or "").split("\n"), (new or "").split("\n")
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    gone, come = a[lo : len(a) - hi], b[lo : len(b) - hi]
    return {"start": lo, "removed": gone[:most], "added": come[:most], "truncated": max(len(gone), len(come)) > most}


@F.pandas_udf(T.StructType().add("start", "integer").add("removed", T.ArrayType(T.StringType())).add("added", T.ArrayType(T.StringType())).add("truncated", "boolean"))
def line_diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([line_diff_of(a, b) for a, b in zip(old, new)], columns=["start", "removed", "added", "truncated"])


def evidence(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, page_number, entity_id, value_text, start_offset, quote, confidence): where the file number of an
    item stands on its first page, from 0, -1 where it doesn't; a quote of at most 1,000 characters."""
    p = pages.select("document_id", "page_number", F.col("content").alias("text"))
    both = items.where(F.col("file_number").isNotNull()).join(p, (items["document_id"] == p["document_id"]) & (F.col("start_page") == F.col("page_number")))
    return both.select(items["document_id"], "page_number", F.col("id").cast("string").alias("entity_id"), F.col("file_number").alias("value_text"), (F.expr("locate(file_number, text)") - 1).cast("int").alias("start_offset"), F.left(items["content"], F.lit(1000)).alias("quote"), F.lit(0.96).cast("decimal(4,3)").alias("confidence"))
