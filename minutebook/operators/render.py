"""Bounded results as JSON, NDJSON and Markdown, and page selections."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_rows(rows: DataFrame) -> DataFrame:
    """(value): each row as a JSON object."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def ndjson(rows: DataFrame, key: str, limit: int) -> Iterable[str]:
    """A page (at most `limit` rows) as lines, with a line of the next cursor if it is full."""
    lines = [(r["value"], r["k"]) for r in rows.limit(limit).select(F.to_json(F.struct(*rows.columns)).alias("value"), F.col(key).alias("k")).collect()]
    yield from (v for v, _ in lines)
    if len(lines) == limit:
        yield json.dumps({"_meta": {"nextCursor": str(lines[-1][1])}})


def _link(r: dict, *names: str) -> str:
    return " · ".join(str(r[n]) for n in names if r.get(n) is not None)


def items_markdown(query: str, rows: list[dict]) -> str:
    """Top results as a Markdown list, with what there is of date, file number, page and text."""
    out = [f"# Results for “{query}”", "", f"{len(rows)} shown", ""]
    for k, r in enumerate(rows, 1):
        out += [f"## {k}. {r.get('title') or 'Untitled'}", _link(r, "meeting_date", "file_number", "start_page", "page_number"), ""]
        if r.get("snippet"):
            out += [f"> {r['snippet']}", ""]
    return "\n".join(out).rstrip() + "\n"


def comments_markdown(query: str, rows: list[dict]) -> str:
    """Comments as quotations under their speakers."""
    out = [f"# Comments on “{query}”", ""]
    for r in rows:
        out += [f"## {r.get('speaker') or 'Unnamed speaker'}", _link(r, "meeting_date", "page_number"), "", f"> {' '.join((r.get('content') or '').split())}", ""]
    return "\n".join(out).rstrip() + "\n"


def votes_markdown(voter: str, rows: list[dict], counts: dict) -> str:
    """A member's votes as a table under their counts."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    line = " · ".join(f"{k} {counts[k]}" for k in ("aye", "no", "absent", "excused") if k in counts)
    table = [f"| {' | '.join(cell(r.get(c)) for c in ('meeting_date', 'file_number', 'position', 'title'))} |" for r in rows]
    return "\n".join([f"# Votes of {voter}", "", line, "", "| Date | File | Vote | Title |", "| --- | --- | --- | --- |", *table]) + "\n"


PARTS = {"item": "Items", "page": "Pages", "comment": "Comments", "housing": "Housing"}


def bundle_markdown(question: str, rows: list[dict]) -> str:
    """An evidence bundle (part, rank, id, title, body as JSON) by parts, in order."""
    out = [f"# {question}", ""]
    for part, heading in PARTS.items():
        own = sorted((r for r in rows if r["part"] == part), key=lambda r: r["rank"])
        if own:
            out += [f"## {heading}", ""]
        for r in own:
            body = json.loads(r["body"])
            out += [f"{r['rank']}. {r['title'] or 'Untitled'}" + (f" ({r['id']})" if r["id"] else ""), *(f"   - {k}: {json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else v}" for k, v in body.items())]
        if own:
            out.append("")
    return "\n".join(out).rstrip() + "\n"


def transcript_markdown(title: str, pages: list[tuple[int, str]]) -> str:
    return "\n\n".join([f"# {title}", *(f"## Page {n}\n\n{text}" for n, text in pages)]) + "\n"


def page_range(selection: str | None, last: int, most: int = 50) -> tuple[int, int]:
    """First and last page of 'n' or 'a-b', at most 50 pages, within the greatest page number."""
    if selection is None:
        return 1, last
    m = re.fullmatch(r"(\d+)(?:-(\d+))?", selection)
    if not m:
        raise ValueError("pages are n or a-b")
    lo, hi = int(m[1]), int(m[2] or m[1])
    if not 1 <= lo <= hi <= last or hi - lo >= most:
        raise ValueError("page range out of bounds")
    return lo, hi


def overlapping(first: Column, last: Column, lo: int, hi: int) -> Column:
    """Whether a range of pages meets lo to hi."""
    return (last >= lo) & (first <= hi)


def sitemap(static: list[str], supervisors: DataFrame, documents: DataFrame) -> DataFrame:
    """(url) of fixed addresses, members and documents."""
    spark = documents.sparkSession
    fixed = spark.createDataFrame([(u,) for u in static], "url string")
    return fixed.union(supervisors.select(F.concat(F.lit("/supervisors/"), "slug"))).union(documents.select(F.concat(F.lit("/documents/"), F.col("id").cast("string"))))
