"""Cutting long texts into overlapping pieces at natural boundaries (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a chunk may end, strongest first: after a blank line, a line, a sentence, a clause, a word.
BOUNDARIES = (r"(?<=\n[ \t]{0,8}\r?\n)", r"(?<=\n)", r"(?<=[.!?][\"'”’)\]]{0,2}\s)|(?<=[。！？])", r"(?<=[;:,]\s)|(?<=[，；：、])", r"(?<=\s)")


def chunk_pattern(most: int) -> str:
    """A pattern whose successive matches are the chunks of a text: each alternative consumes up to the limit and gives
    back until its boundary is met, but not below half the limit, where a weaker boundary is the better choice. Where
    no boundary is in reach, a chunk ends after any character that no combining mark follows, or in the end after any."""
    least = max(1, most // 2)
    tried = [f".{{1,{most}}}\\z", *(f".{{{least},{most}}}(?:{b})" for b in BOUNDARIES), f".{{{least},{most}}}(?![\\p{{M}}\\n])", f".{{1,{most}}}"]
    return f"(?s)(?:{'|'.join(tried)})"


def chunks(text: Column, limit: int, overlap: int) -> Column:
    """Consecutive chunks whose concatenation is the text, none longer than limit - overlap where there are several."""
    if not 0 <= overlap <= limit // 4:
        raise ValueError("overlap must be at most a quarter of the limit")
    cut = F.regexp_extract_all(text, F.lit(chunk_pattern(limit - overlap)), F.lit(0))
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).when(F.length(text) <= limit, F.array(text)).otherwise(cut)


def with_pieces(df: DataFrame, text: str, limit: int = 4000, overlap: int = 200, to: str = "pieces") -> DataFrame:
    """df with an array of (piece_no, start, text): text of at most `limit` code points, start its place in the whole
    text, counted from 0. Every piece but the first repeats the last `overlap` code points before its own chunk. Null
    and empty texts have no pieces; a text within the limit is one piece. Other columns stay as they are."""

    def laid(c: Column) -> Column:
        starts = F.aggregate(c, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))

        def piece(x: Column, i: Column) -> Column:
            back = F.when(i > 0, F.right(F.get(c, i - 1), F.lit(overlap))).otherwise(F.lit(""))
            return F.struct(i.cast("int").alias("piece_no"), F.length(back).alias("back"), F.concat(back, x).alias("text"))

        return F.zip_with(F.transform(c, piece), F.slice(starts, 1, F.size(c)), lambda p, s: F.struct(p["piece_no"].alias("piece_no"), (s - p["back"]).alias("start"), p["text"].alias("text")))

    once = F.transform(F.array(chunks(F.col(text), limit, overlap)), laid)
    return df.withColumn(to, F.element_at(once, 1))


def record_chunks(records: DataFrame, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """(record_table, record_id, chunks) of (record_table, record_id, content). A record that arrives twice comes out twice."""
    return records.select("record_table", "record_id", chunks(F.col("content"), limit, overlap).alias("chunks"))


def record_pieces(records: DataFrame, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """(record_table, record_id, piece_no, start, text); rows that arrive twice as exact copies count once."""
    once = with_pieces(records, "content", limit, overlap).select("record_table", "record_id", F.explode("pieces").alias("p"))
    return once.select("record_table", "record_id", "p.piece_no", "p.start", "p.text").distinct()
