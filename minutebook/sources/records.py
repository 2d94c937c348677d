"""Readers: text and HTML to pages, catalogs, calendars, file names, JSON recordsets."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Formats of file names and catalog entries.
FILE_NAME = r"(?:^|/)(\d{4}-\d{2}-\d{2})_(?:(\d+)_([0-9A-Fa-f-]+)_)?(agenda|minutes)\.[A-Za-z]+$"
BAG_NAME = r"(?:^|/)bag(\d{2})(\d{2})(\d{2})_(agenda|minutes)\.[A-Za-z]+$"
LINK = r'(?is)<li[^>]*>\s*<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
ENGLISH_DATE = r"(?i)((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4})"


def split_pages(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_number, content): a form feed ends a page; pages are numbered before empty ones are dropped, so that
    numbers keep their gaps. Zero bytes and blanks at line ends go."""
    parts = documents.select(key, F.posexplode(F.split(F.col(text), "\f")).alias("at", "raw"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("raw", "\0", ""), r"[ \t]+(?=\n)", ""))
    clean = F.regexp_replace(clean, r"^\s+|\s+$", "")
    return parts.select(key, (F.col("at") + 1).alias("page_number"), clean.alias("content")).where(F.col("content") != "")


def two_digit_year(yy: Column) -> Column:
    return F.when(yy >= 90, yy + 1900).otherwise(yy + 2000)


def file_records(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, meeting_date, kind, event_id, event_guid) of file names in any of the three formats; others are left
    out."""
    p = F.col(path)
    part = lambda i: F.nullif(F.regexp_extract(p, FILE_NAME, i), F.lit(""))
    bag = lambda i: F.nullif(F.regexp_extract(p, BAG_NAME, i), F.lit(""))
    year = two_digit_year(bag(3).cast("int"))
    old = F.try_to_date(F.concat_ws("-", year.cast("string"), bag(1), bag(2))) if hasattr(F, "try_to_date") else F.to_date(F.concat_ws("-", year.cast("string"), bag(1), bag(2)))
    out = paths.select(path, F.coalesce(part(1).cast("date"), old).alias("meeting_date"), F.coalesce(part(4), bag(4)).alias("kind"), part(2).cast("long").alias("event_id"), F.upper(part(3)).alias("event_guid"))
    return out.where(F.col("meeting_date").isNotNull() & F.col("kind").isNotNull()).orderBy("meeting_date", "kind", path)


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """Documents below a folder, with the record that their names give and the whole text."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return raw.join(file_records(raw.select("path")), "path")


def catalog_links(pages: DataFrame, year: str, markup: str) -> DataFrame:
    """(url, meeting_date, year, kind, source_format, title) of the links of yearly catalog pages with sections Agendas
    and Minutes. Links of another year are dropped; of a URL that comes twice the last entry counts."""
    sections = F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_extract(F.col(markup), rf"(?is)<h\d[^>]*>\s*{name}\s*</h\d>(.*?)(?:<h\d|\z)", 1).alias("part")) for kind, name in (("agenda", "Agendas?"), ("minutes", "Minutes"))])
    rows = pages.select(F.col(year).alias("year"), F.explode(sections).alias("s")).where(F.col("s.part") != "")
    urls, labels = F.regexp_extract_all("s.part", F.lit(LINK), F.lit(1)), F.regexp_extract_all("s.part", F.lit(LINK), F.lit(2))
    rows = rows.select("year", "s.kind", F.posexplode(F.arrays_zip(urls.alias("url"), labels.alias("label"))).alias("at", "l"))
    label = F.trim(F.regexp_replace(F.regexp_replace("l.label", "<[^>]*>", " "), r"\s+", " "))
    date = F.to_date(F.try_to_timestamp(F.regexp_extract(label, ENGLISH_DATE, 1), F.lit("MMMM d, yyyy")))
    rows = rows.select("year", "kind", "at", F.col("l.url").alias("url"), label.alias("title"), date.alias("meeting_date"))
    rows = rows.where(F.year("meeting_date") == F.col("year"))
    form = F.when(F.lower("url").rlike(r"\.pdf($|\?)"), "pdf").otherwise("html")
    best = rows.groupBy("url").agg(F.max(F.struct("at", "meeting_date", "year", "kind", "title")).alias("r"))
    return best.select("url", "r.meeting_date", "r.year", "r.kind", form.alias("source_format"), "r.title")


def feed_events(feed: DataFrame, xml: str) -> DataFrame:
    """(event_id, event_guid, meeting_date) of the items of calendar feeds."""
    item = F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<item>(.*?)</item>"), F.lit(1)))
    rows = feed.select(item.alias("i"))
    link = F.regexp_replace(F.regexp_extract("i", r"(?is)<link>(.*?)</link>", 1), "&amp;", "&")
    date = F.regexp_extract("i", r"(?is)<title>[^<]*?(\d{1,2}/\d{1,2}/\d{4})", 1)
    out = rows.select(F.regexp_extract(link, r"[?&]ID=(\d+)", 1).try_cast("long").alias("event_id"), F.upper(F.regexp_extract(link, r"(?i)[?&]GUID=([0-9A-F-]+)", 1)).alias("event_guid"), F.to_date(F.try_to_timestamp(date, F.lit("M/d/yyyy"))).alias("meeting_date"))
    return out.where(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.max("event_guid").alias("event_guid"), F.max("meeting_date").alias("meeting_date"))


def calendar_rows(pages: DataFrame, markup: str) -> DataFrame:
    """(source_key, meeting_date, event_id, event_guid, kind) of the rows of calendar tables; a row whose links name
    different events is dropped, of a key that comes twice the last counts."""
    rows = pages.select(F.posexplode(F.regexp_extract_all(F.col(markup), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("at", "row"))
    date = F.to_date(F.try_to_timestamp(F.regexp_extract("row", r"(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit("M/d/yyyy")))
    links = F.regexp_extract_all(F.regexp_replace("row", "&amp;", "&"), F.lit(r"(?i)href=\"[^\"]*?M=([AM])&ID=(\d+)&GUID=[0-9A-F-]+"), F.lit(0))
    rows = rows.select("at", date.alias("meeting_date"), F.explode(links).alias("l"))
    rows = rows.select("at", "meeting_date", F.regexp_extract("l", r"ID=(\d+)", 1).cast("long").alias("event_id"), F.upper(F.regexp_extract("l", r"(?i)GUID=([0-9A-F-]+)", 1)).alias("event_guid"), F.when(F.regexp_extract("l", r"(?i)M=([AM])", 1) == "A", "agenda").otherwise("minutes").alias("kind"))
    rows = rows.where(F.col("meeting_date").isNotNull()).withColumn("source_key", F.concat_ws(":", "event_id", "kind"))
    best = rows.groupBy("source_key").agg(F.max(F.struct("at", "meeting_date", "event_id", "event_guid", "kind")).alias("r"))
    return best.select("source_key", "r.meeting_date", "r.event_id", "r.event_guid", "r.kind")


def archive_links(pages: DataFrame, markup: str) -> DataFrame:
    """(meeting_date, url) of links of the old archive, whose names are bagMMDDYY."""
    url = F.explode(F.regexp_extract_all(F.col(markup), F.lit(r'(?i)href="([^"]*bag\d{6}[^"]*)"'), F.lit(1)))
    rows = pages.select(url.alias("url"))
    digits = F.regexp_extract("url", r"(?i)bag(\d{6})", 1)
    year = two_digit_year(F.substring(digits, 5, 2).cast("int"))
    date = F.to_date(F.try_to_timestamp(F.concat_ws("-", year.cast("string"), F.substring(digits, 1, 2), F.substring(digits, 3, 2)), F.lit("yyyy-MM-dd")))
    return rows.select(date.alias("meeting_date"), "url").where(F.col("meeting_date").isNotNull()).distinct()


def container_of(markup: str, mark: str = "content") -> str:
    """What the first div with this id or class holds, counting inner divs; all of it where there is none."""
    start = re.search(rf'(?i)<div\b[^>]*\b(?:id|class)="[^"]*\b{mark}\b[^"]*"[^>]*>', markup)
    if not start:
        return markup
    depth = 1
    for m in re.finditer(r"(?i)<(/?)div\b[^>]*>", markup[start.end() :]):
        depth += -1 if m[1] else 1
        if depth == 0:
            return markup[start.end() : start.end() + m.start()]
    return markup[start.end() :]


def text_of(markup: str | None, mark: str = "content", least: int = 80, fallback: str = "[No text on this page]") -> str | None:
    if markup is None:
        return None
    s = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", container_of(markup, mark))
    s = re.sub(r"(?i)<li\b[^>]*>", "\n• ", s)
    s = re.sub(r"(?i)</t[dh]\s*>", "\t", s)
    s = re.sub(r"(?i)<br\s*/?>|</?(?:p|div|h\d|tr|table|ul|ol|section|article|li)\b[^>]*>", "\n", s)
    s = html.unescape(re.sub(r"<[^>]*>", "", s)).replace("\xa0", " ")
    lines = [re.sub(r"[ \t]+", lambda m: "\t" if "\t" in m[0] else " ", x).strip() for x in s.split("\n")]
    out = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    return out if len(out) >= least else fallback


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    return s.map(text_of)


def with_fallback(text: DataFrame, scanned: DataFrame, least: int = 20) -> DataFrame:
    """(document_id, page_number, content, method): the text of a page, or its scan's where the text is under `least`
    characters; documents of which no page has that many are dropped. Both sides: (document_id, page_number, content)."""
    both = text.withColumnRenamed("content", "t").join(scanned.withColumnRenamed("content", "s"), ["document_id", "page_number"], "full")
    plain = F.length(F.trim(F.coalesce("t", F.lit("")))) >= least
    rows = both.select("document_id", "page_number", F.when(plain, F.col("t")).otherwise(F.coalesce("s", "t")).alias("content"), plain.alias("plain"))
    of = rows.groupBy("document_id").agg(F.max(F.length(F.trim(F.coalesce("content", F.lit(""))))).alias("longest"), F.count_if("plain").alias("n"), F.count("*").alias("all"))
    method = F.when(F.col("n") == F.col("all"), "text").when(F.col("n") == 0, "scan").otherwise("text+scan")
    return rows.join(of.where(F.col("longest") >= least).select("document_id", method.alias("method")), "document_id").drop("plain")


def recordset(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """The rows of a JSON array of objects."""
    return rows.select(F.inline(F.from_json(F.col(column), f"array<struct<{schema}>>")))


def verified(files: DataFrame, content: str = "content") -> DataFrame:
    """files with is_pdf (magic bytes) and sha256, to compare with what is stored."""
    return files.withColumns({"is_pdf": F.substring(content, 1, 4) == F.lit(b"%PDF"), "sha256": F.sha2(F.col(content), 256)})


def service_dates(rows: DataFrame, text: str) -> DataFrame:
    """rows with first_date and last_date: the least and greatest date (M/d/yyyy) that a text names."""
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"(\d{1,2}/\d{1,2}/\d{4})"), F.lit(1)), lambda x: F.to_date(F.try_to_timestamp(x, F.lit("M/d/yyyy"))))
    return rows.withColumns({"first_date": F.array_min(found), "last_date": F.array_max(found)})


def former_members(rows: DataFrame, text: str, since: str = "1996-01-01", at_large_until: str = "2001-01-08") -> DataFrame:
    """service_dates() of those who served since a day, with district_default: At-large for those who left by the end of
    that era, else null. Texts without a date are left out."""
    dated = service_dates(rows, text).where(F.col("last_date") >= F.lit(since).cast("date"))
    return dated.withColumn("district_default", F.when(F.col("last_date") <= F.lit(at_large_until).cast("date"), "At-large"))


def roster(scraped: DataFrame, curated: DataFrame, least: int = 11) -> DataFrame:
    """The scraped roster if it has at least so many members, else the curated one: a page that has changed its form
    must not empty the table. Both are (slug, ...) of the same columns; the choice is part of the plan."""
    enough = scraped.agg((F.countDistinct("slug") >= least).alias("_enough"))  # one row
    pick = lambda rows, keep: rows.crossJoin(F.broadcast(enough)).where(F.col("_enough") if keep else ~F.col("_enough")).drop("_enough")
    return pick(scraped.dropDuplicates(["slug"]), True).unionByName(pick(curated, False))


MATTER = "MatterId long, MatterFile string, MatterTitle string, MatterTypeName string, MatterStatusName string, MatterIntroDate string, MatterPassedDate string"


def matters(answers: DataFrame, column: str) -> DataFrame:
    """(matter_id, file_number, title, type, status, introduced, passed) of JSON answers, each an array of matters or
    not JSON at all, which then holds none. Of a matter that comes twice the last by status and dates is kept."""
    m = recordset(answers.where(F.col(column).isNotNull()), column, MATTER.replace(" ", ":"). replace(",:", ","))
    day = lambda c: F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))
    rows = m.where(F.col("MatterId").isNotNull()).select(
        F.col("MatterId").alias("matter_id"), F.trim("MatterFile").alias("file_number"), F.trim("MatterTitle").alias("title"), F.col("MatterTypeName").alias("type"), F.col("MatterStatusName").alias("status"), day("MatterIntroDate").alias("introduced"), day("MatterPassedDate").alias("passed")
    )
    best = rows.groupBy("matter_id").agg(F.max(F.struct("passed", "introduced", "status", "file_number", "title", "type")).alias("r"))
    return best.select("matter_id", *[F.col("r")[c].alias(c) for c in ("file_number", "title", "type", "status", "introduced", "passed")])
