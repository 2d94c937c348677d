"""Column functions on names, titles and actions; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and their plain forms, by the rule of compatibility decomposition.
_PAIRS = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(c))) > 1 and d[0].isascii() and d[0].isalpha()]
ACCENTED, PLAIN = "".join(a for a, _ in _PAIRS), "".join(p for _, p in _PAIRS)

# Action classes in order of precedence; the first four are matched as written, the others in any case.
ACTION_CLASSES = (
    ("final-passage", "FINALLY PASSED"),
    ("first-reading", "FIRST READING"),
    ("adoption", r"\bADOPTED\b"),
    ("approval", r"\bAPPROVED\b"),
    ("rescission", r"(?i)\bRESCIND"),
    ("continuance", r"(?i)\bCONTINU"),
    ("amendment", r"(?i)\bAMEND"),
    ("referral", r"(?i)\bREFER"),
    ("tabling", r"(?i)\bTABL"),
    ("rejection", r"(?i)\b(REJECT|FAIL|DENI)"),
)
FINAL = r"FINALLY PASSED|\bADOPTED\b|\bAPPROVED\b"


def squeeze(c: Column) -> Column:
    """Runs of white space, no-break spaces included, become one space."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def unaccent(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def name_key(c: Column) -> Column:
    """Letters and digits of a name in lower case without accents."""
    return F.regexp_replace(F.lower(unaccent(c)), "[^a-z0-9]", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(unaccent(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def matter_key(title: Column) -> Column:
    """The last part of a title after ' - ', without a leading 'proposed' and in letters and digits."""
    last = F.element_at(F.split(title, r"\s+-\s+"), -1)
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(squeeze(last), r"(?i)^proposed\s+", ""), "[^A-Za-z0-9]+", " ")))


def action_type(action: Column) -> Column:
    out = None
    for name, pattern in ACTION_CLASSES:
        hit = action.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def is_final(action: Column) -> Column:
    return ~action.rlike("FIRST READING") & action.rlike(FINAL)


def file_number(query: Column) -> Column:
    """The first number of exactly six digits; null if there is none."""
    return F.nullif(F.regexp_extract(query, r"(?:^|\D)(\d{6})(?:\D|$)", 1), F.lit(""))


def shorten(c: Column, most: int) -> Column:
    """At most this many characters, cut before the last word with an ellipsis."""
    s = squeeze(c)
    return F.when(F.length(s) > most, F.concat(F.regexp_replace(F.substring(s, 1, most), r"\s+\S*$", ""), F.lit("…"))).otherwise(s)


def plain_title(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+—\s+", ": ")


def document_path(document_id: Column, day: Column, kind: Column) -> Column:
    return F.concat(F.lit("/documents/"), document_id.cast("string"), F.lit("/"), F.date_format(day, "yyyy-MM-dd"), F.lit("-"), kind)


def short_name(display: Column) -> Column:
    """First and last word of a name of more than two."""
    parts = F.split(squeeze(display), " ")
    return F.when(F.size(parts) > 2, F.concat(F.element_at(parts, 1), F.lit(" "), F.element_at(parts, -1))).otherwise(squeeze(display))
