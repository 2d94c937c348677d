"""Queries of problem 3 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutebook.operators import history
from minutebook.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = history.supervisor_versions(table(spark, sf_dir, "supervisor_snapshots"))
    return v.select(
        "feed",
        "supervisor_id",
        F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"),
        F.coalesce(F.date_format("valid_to", "yyyy-MM-dd"), F.lit(history.OPEN)).alias("valid_to"),
    )


def p3_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = history.supervisor_versions(table(spark, sf_dir, "supervisor_snapshots"))
    return v.select("feed", "supervisor_id", "district", "active", "term_start", "valid_from", "valid_to")


QUERIES = {"p3_found": p3_found, "p3_history": p3_history}

_RUNS = r"""
with d as (
  select feed, supervisor_id, snapshot_date, captured_at, active,
    trim(regexp_replace(lower(district), '[\s_-]+', ' ', 'g')) as d0,
    case
      when regexp_matches(trim(term_start), '^\d{4}-\d{1,2}-\d{1,2}') then strftime(try_strptime(regexp_extract(trim(term_start), '^(\d{4}-\d{1,2}-\d{1,2})', 1), '%Y-%m-%d'), '%Y-%m-%d')
      when term_start like '%/%' then strftime(try_strptime(trim(term_start), '%m/%d/%Y'), '%Y-%m-%d')
      else strftime(try_strptime(trim(term_start), '%B %d, %Y'), '%Y-%m-%d') end as term_start
  from supervisor_snapshots where snapshot_date is not null
), e as (
  select *, case when regexp_matches(d1, '^\d+$') then cast(cast(d1 as int) as varchar) else d1 end as district
  from (select *, trim(regexp_replace(d0, '^(district|dist\.?)\s*', '')) as d1 from d)
), f as (
  select * from (select *, row_number() over (partition by feed, supervisor_id, snapshot_date order by captured_at desc, district desc nulls last, active desc nulls last, term_start desc nulls last) as k from e) where k = 1
), g as (
  select *, lag(struct_pack(a := district, b := active, c := term_start)) over w is distinct from struct_pack(a := district, b := active, c := term_start) as starts,
    row_number() over w as n
  from f window w as (partition by feed, supervisor_id order by snapshot_date)
), h as (
  select *, lead(snapshot_date) over (partition by feed, supervisor_id order by snapshot_date) as valid_to
  from g where starts or n = 1
)
"""

ORACLE = {
    "p3_found": _RUNS + "select feed, supervisor_id, strftime(snapshot_date, '%Y-%m-%d') as valid_from, coalesce(strftime(valid_to, '%Y-%m-%d'), 'open') as valid_to from h",
    "p3_history": _RUNS + "select feed, supervisor_id, district, active, term_start, snapshot_date as valid_from, valid_to from h",
}
