"""The queries of the problems and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutebook.llm import addresses, byte_bpe, encodings, mixing, names, near_duplicates, pieces, repeated_lines, scanned
from minutebook.session import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.item_pairs(table(spark, sf_dir, "legislative_items"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.item_groups(table(spark, sf_dir, "legislative_items"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.typed_names(table(spark, sf_dir, "roll_calls"), table(spark, sf_dir, "public_comments"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.spelling_pairs(_names(spark, sf_dir))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked(_names(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.same_building(addresses.records(table(spark, sf_dir, "extracted_facts")))


def p4_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.resolved(addresses.records(table(spark, sf_dir, "extracted_facts")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.faults(table(spark, sf_dir, "pages")).select("page_id", "line_no", "fault").distinct()


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = scanned.scanned(table(spark, sf_dir, "pages"))
    return scanned.paragraphs(scan, cut(scanned.faults_of(scan)))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name: table(spark, sf_dir, name).select(F.lit(name).alias("record_table"), F.col("id").alias("record_id"), "content")
    return of("pages").unionByName(of("legislative_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces.record_chunks(_records(spark, sf_dir)).where(F.size("chunks") > 1)
    return cut.select("record_table", "record_id").distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.record_pieces(_records(spark, sf_dir))


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated(table(spark, sf_dir, "pages"), table(spark, sf_dir, "meeting_documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(spark, sf_dir).select("page_id", "line_no")


def p7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates with up to a third of their words open."""
    lines = repeated_lines.lines_of(table(spark, sf_dir, "pages"), table(spark, sf_dir, "meeting_documents"))
    return repeated_lines.templates(*lines, slots=1 / 3).select("kind", "template", "slots", "documents").distinct()


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.without_repeated(table(spark, sf_dir, "pages"), _repeated(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(table(spark, sf_dir, "documents"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of the documents whose source is to be mixed."""
    wanted = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "mix_targets").select("source").distinct(), "source", "left_semi")
    return cut(byte_bpe.token_counts(wanted, "doc_id", "text", ["source"]))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.in_order(mixing.mixed(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")))


def _shares(spark: SparkSession, sf_dir: str, total: str | None) -> DataFrame:
    sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mixed(sized, targets, total=total), mixing.demands(sized, targets, total))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir, None)


def p9_shares_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix that reaches every share, however small that makes it."""
    return _shares(spark, sf_dir, mixing.EXACT)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.repaired(table(spark, sf_dir, "documents")).select("doc_id")


def p10_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.repaired(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_entities": p2_entities,
    "p4_found": p4_found,
    "p4_resolved": p4_resolved,
    "p5_found": p5_found,
    "p5_paragraphs": p5_paragraphs,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_found": p7_found,
    "p7_templates": p7_templates,
    "p7_clean": p7_clean,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_shares_exact": p9_shares_exact,
    "p10_found": p10_found,
    "p10_repaired": p10_repaired,
}

ORACLE: dict[str, str] = {
    "p6_found": """
select 'pages' as record_table, id as record_id from pages where length(content) > 4000 and id is not null
union select 'legislative_items', id from legislative_items where length(content) > 4000 and id is not null""",
    "p7_found": r"""
with docs as (select id, max(coalesce(kind, '')) as kind from meeting_documents where id is not null group by id),
lines as (
  select p.document_id, p.id as page_id, d.kind, unnest(string_split(p.content, chr(10))) as text, unnest(range(len(string_split(p.content, chr(10))))) as line_no
  from (select distinct id, document_id, content from pages) p join docs d on d.id = p.document_id where content is not null
), keyed as (
  select *, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from lines
), counted as (
  select *, array_to_string(w, ' ') as line from keyed where len(list_filter(w, lambda x: regexp_matches(x, '^\p{L}+$'))) >= 5
), totals as (select kind, count(*) as total from docs group by kind),
often as (
  select c.kind, c.line from counted c join totals t on t.kind = c.kind group by c.kind, c.line, t.total
  having count(distinct document_id) >= 3 and count(distinct document_id) >= 0.08 * t.total
)
select distinct page_id, cast(line_no as int) as line_no from counted join often using (kind, line)""",
}
