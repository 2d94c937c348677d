"""Filters, joins, aggregates, windows, sorts and set operations on the star tables; each name begins with the
operators it stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minutebook.operators import feed, merge
from minutebook.session import table
from minutebook.sources import records

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def conditions(from_year: int | None = None, to_year: int | None = None, year: int | None = None, status: str | None = None, low: float | None = None) -> list:
    """Filters of the parameters that are given; an exact year stands before a range."""
    out = []
    if year is not None:
        from_year = to_year = year
    if from_year is not None or to_year is not None:
        out.append(F.col("o_orderdate").between(f"{from_year or 1900}-01-01", f"{to_year or 2100}-12-31 23:59:59"))
    if status is not None:
        out.append(F.col("o_orderstatus") == status)
    if low is not None:
        out.append(F.col("o_totalprice") < low)
    return out


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_orderdate between '1995-01-01' and '1996-12-31 23:59:59' and o_orderstatus = 'F' and o_totalprice < 200000")
def f_optional_filters(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders")
    for c in conditions(1995, 1996, None, "F", 200000.0):
        rows = rows.where(c)
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(r"""
select o_orderpriority, case when regexp_matches(o_orderpriority, 'URGENT') then 'urgent' when regexp_matches(o_orderpriority, '(?i)^\d-h') then 'high'
  when regexp_matches(o_orderpriority, '(?i)low$') then 'low' else 'other' end as class, not regexp_matches(o_orderpriority, 'LOW') and regexp_matches(o_orderpriority, 'URGENT|HIGH') as pressing, count(*) as n
from orders group by all""")
def f_regex_classify(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_orderpriority")
    kind = F.when(p.rlike("URGENT"), "urgent").when(p.rlike(r"(?i)^\d-h"), "high").when(p.rlike("(?i)low$"), "low").otherwise("other")
    return table(spark, sf, "orders").groupBy("o_orderpriority", kind.alias("class"), (~p.rlike("LOW") & p.rlike("URGENT|HIGH")).alias("pressing")).agg(F.count("*").alias("n"))


@query("""
with a as (select c_custkey, list(distinct lower(o_orderstatus)) as s from customer join orders on o_custkey = c_custkey group by c_custkey)
select c_custkey from a where list_contains(s, 'p')""")
def f_array_any(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderstatus").alias("s"))
    return a.where(F.exists("s", lambda x: F.lower(x) == "p")).select("c_custkey")


@query("select p_partkey, p_name from part where contains(p_name, 'a') and p_type ilike '%e%' and p_size in (1, 5, 9, 15)")
def f_substring_and_members(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.where(F.col("p_name").contains("a") & F.col("p_type").ilike("%e%") & F.col("p_size").isin(1, 5, 9, 15)).select("p_partkey", "p_name")


@query("""
select d.doc_id from documents d join (select doc_id, case when doc_id % 3 = 0 then null else lang end as lang2 from documents) e using (doc_id) where d.lang is distinct from e.lang2""")
def f_null_safe_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang")
    changed = d.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("lang")))
    return merge.changed(d, changed, ["doc_id"], ["lang"]).select("doc_id")


@query("""
select r_name, n_name, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all""")
def jn_star_chain(spark: SparkSession, sf: str) -> DataFrame:
    l, o, c = (table(spark, sf, n) for n in ("lineitem", "orders", "customer"))
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("select o_orderkey, count(l_linenumber) as lines, min(l_shipdate) as first_ship, max(l_shipdate) as last_ship from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def jn_left_zero(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("lines"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    o = table(spark, sf, "orders").groupBy("o_orderkey").agg(F.lit(1).alias("_"))
    return o.join(own, "o_orderkey", "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), "first_ship", "last_ship")


@query("""
select o_orderkey, l.l_partkey, l.l_quantity from orders left join lateral (
  select l_partkey, l_quantity from lineitem where l_orderkey = o_orderkey and l_shipdate between o_orderdate and o_orderdate + interval 30 day
  order by l_quantity desc, l_partkey, l_suppkey, l_extendedprice limit 1) l on true where o_orderstatus = 'F'""")
def jn_lateral_top1_range(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity", "l_partkey", "l_suppkey", "l_extendedprice")
    within = (F.col("l_orderkey") == F.col("o_orderkey")) & F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 30 days"))
    best = o.join(l, within).groupBy("o_orderkey").agg(F.min(F.struct(-F.col("l_quantity"), "l_partkey", "l_suppkey", "l_extendedprice")).alias("b"))
    return o.join(best, "o_orderkey", "left").select("o_orderkey", F.col("b.l_partkey").alias("l_partkey"), (-F.col("b")["col1"]).alias("l_quantity"))


@query("select o_orderkey, max(l_shipdate) as last_ship, arg_max(l_partkey, (l_shipdate, l_partkey)) as last_part from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def jn_latest_child(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"), F.max_by("l_partkey", F.struct("l_shipdate", "l_partkey")).alias("last_part"))
    return table(spark, sf, "orders").select("o_orderkey").join(l, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "last_ship", "last_part")


@query("""
with t as (select user_id, ts as term_start, lead(ts) over (partition by user_id order by ts, event_id) as term_end, event_id as term from events where event_type = 'signup')
select e.event_id, t.term from events e join t on e.user_id = t.user_id and e.ts >= t.term_start and (t.term_end is null or e.ts < t.term_end) where e.event_type = 'purchase'
qualify row_number() over (partition by e.event_id order by t.term_start desc, t.term desc) = 1""")
def jn_interval_asof(spark: SparkSession, sf: str) -> DataFrame:
    """As-of by one ordered pass: the last start at or before each row of its user, without pairing rows and terms."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("signup", "purchase")).select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "signup", 0).otherwise(1), "event_id")
    term = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("term", term).where("event_type = 'purchase' and term is not null").select("event_id", "term")


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def jn_semi(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, sf, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def jn_anti(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("""
with e as (select vec_id as doc_id from embeddings)
select d.doc_id, d.published_at is null as unpublished from documents d left join e using (doc_id) where e.doc_id is null and (d.published_at is null or d.published_at < timestamptz '2020-01-01 00:00:00+00')""")
def jn_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """What has no vector yet and is undated or old."""
    d, e = table(spark, sf, "documents"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    rows = d.join(e, "doc_id", "left_anti").where(F.col("published_at").isNull() | (F.col("published_at") < F.lit("2020-01-01").cast("timestamp")))
    return rows.orderBy(F.asc_nulls_first("published_at"), "doc_id").select("doc_id", F.col("published_at").isNull().alias("unpublished"))


@query("""
with m as (
  select s_suppkey, c_custkey, 1 as p from supplier join customer on s_nationkey = c_nationkey and round(s_acctbal) = round(c_acctbal)
  union all select s_suppkey, c_custkey, 2 from supplier join customer on s_suppkey = c_custkey
  union all select s_suppkey, min(c_custkey), 3 from supplier join customer on s_nationkey = c_nationkey group by s_suppkey)
select s_suppkey, c_custkey, p as priority from m qualify row_number() over (partition by s_suppkey order by p, c_custkey) = 1""")
def jn_or_priority(spark: SparkSession, sf: str) -> DataFrame:
    """An OR of conditions by preference: each is an equi-join of its own, so no pairs are tried."""
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    one = s.join(c, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.round("s_acctbal") == F.round("c_acctbal"))).select("s_suppkey", "c_custkey", F.lit(1).alias("priority"))
    two = s.join(c, F.col("s_suppkey") == F.col("c_custkey")).select("s_suppkey", "c_custkey", F.lit(2).alias("priority"))
    least = c.groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.min("c_custkey").alias("c_custkey"))
    three = s.join(least, "s_nationkey").select("s_suppkey", "c_custkey", F.lit(3).alias("priority"))
    best = one.union(two).union(three).groupBy("s_suppkey").agg(F.min(F.struct("priority", "c_custkey")).alias("b"))
    return best.select("s_suppkey", "b.c_custkey", "b.priority")


@query("""
with a as (select c_custkey, c_mktsegment from customer where c_custkey % 5 <> 0), b as (select c_custkey, case when c_custkey % 7 = 0 then 'MOVED' else c_mktsegment end as c_mktsegment from customer where c_custkey % 3 <> 0)
select coalesce(a.c_custkey, b.c_custkey) as c_custkey, case when a.c_custkey is null then 'added' when b.c_custkey is null then 'removed' else 'modified' end as change
from a full join b on a.c_custkey = b.c_custkey where a.c_mktsegment is distinct from b.c_mktsegment""")
def jn_full_outer_diff(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    a = c.where("c_custkey % 5 <> 0").withColumnRenamed("c_mktsegment", "x")
    b = c.where("c_custkey % 3 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "MOVED").otherwise(F.col("c_mktsegment"))).withColumnRenamed("c_mktsegment", "y")
    both = a.join(b, "c_custkey", "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.select("c_custkey", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("modified").alias("change"))


@query("select l_suppkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) as flags, count(distinct l_partkey) as parts from lineitem group by l_suppkey")
def ag_distinct_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.slice(F.array_sort(F.collect_set("l_returnflag")), 1, 5), ",").alias("flags"), F.countDistinct("l_partkey").alias("parts"))


@query("""
select year(o_orderdate) as year, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus = 'O') as o, count(*) filter (where o_orderstatus = 'P') as p, max(o_totalprice) filter (where o_orderstatus = 'F') as top_f
from orders group by 1""")
def ag_pivot_filter(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(*[F.count_if(s == x).alias(x.lower()) for x in "FOP"], F.max(F.when(s == "F", F.col("o_totalprice"))).alias("top_f"))


@query("""
select (select count(*) from orders) as orders, (select count(*) from orders where o_orderstatus = 'P') as pending, (select count(*) from customer) as customers,
  (select count(*) from documents where text is null) as without_text, (select count(distinct source) from documents) as sources, (select count(*) from events where event_type = 'error') as errors""")
def ag_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """Independent counts in one row: one pass a table, joined as single rows."""
    one = [
        table(spark, sf, "orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "P").alias("pending")),
        table(spark, sf, "customer").agg(F.count("*").alias("customers")),
        table(spark, sf, "documents").agg(F.count_if(F.col("text").isNull()).alias("without_text"), F.countDistinct("source").alias("sources")),
        table(spark, sf, "events").agg(F.count_if(F.col("event_type") == "error").alias("errors")),
    ]
    out = one[0]
    for row in one[1:]:
        out = out.crossJoin(F.broadcast(row))  # one row each
    return out


@query("select user_id, n, rank from (select *, row_number() over (order by n desc, user_id) as rank from (select user_id, count(*) as n from events where event_type = 'error' group by user_id)) where rank <= 20")
def ag_top_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    top = table(spark, sf, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "user_id")))


@query("""
with m as (select l.*, o_orderdate, o_custkey from lineitem l join orders on l_orderkey = o_orderkey where l_quantity >= 45),
g as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) as k, count(*) over (partition by o_custkey) as group_count from m)
select o_custkey, l_orderkey, l_partkey, group_count, count(*) over () as total from g where k = 1""")
def w_group_rank_total(spark: SparkSession, sf: str) -> DataFrame:
    """Newest of each group with the group's size and the number of groups; counts apart from the rank, so that only
    one row a group is sorted on and nothing runs in one task."""
    m = table(spark, sf, "lineitem").where("l_quantity >= 45").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    best = m.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("b"), F.count("*").alias("group_count"))
    total = best.agg(F.count("*").alias("total"))
    return best.crossJoin(F.broadcast(total)).select("o_custkey", "b.l_orderkey", "b.l_partkey", "group_count", "total")


@query("""
select c_custkey, rank from (select c_custkey, row_number() over (order by c_mktsegment = 'BUILDING' desc, case when c_mktsegment = 'BUILDING' then c_nationkey end asc nulls last, c_acctbal desc, c_custkey) as rank from customer) where rank <= 50""")
def t_custom_sort_topk(spark: SparkSession, sf: str) -> DataFrame:
    first = F.col("c_mktsegment") == "BUILDING"
    order = (F.desc("first"), F.asc_nulls_last("near"), F.desc("c_acctbal"), F.asc("c_custkey"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal", first.alias("first"), F.when(first, F.col("c_nationkey")).alias("near"))
    return rows.orderBy(*order).limit(50).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("c_custkey", "rank")


@query("""
select l_orderkey, 'flag' as position, l_returnflag as value from lineitem union select l_orderkey, 'status', l_linestatus from lineitem""")
def set_stack_positions(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    pairs = F.explode(F.array(F.struct(F.lit("flag").alias("position"), F.col("l_returnflag").alias("value")), F.struct(F.lit("status").alias("position"), F.col("l_linestatus").alias("value"))))
    return l.select("l_orderkey", pairs.alias("p")).select("l_orderkey", "p.position", "p.value").distinct()


@query("""
select 'page' as entity, id as key, content from (select distinct * from pages) where content is not null
union all select 'item', id, coalesce(title, '') || chr(10) || coalesce(content, '') from (select distinct * from legislative_items)
union all select 'comment', id, content from (select distinct * from public_comments) where content is not null""")
def set_corpus_union(spark: SparkSession, sf: str) -> DataFrame:
    """The texts to embed, whole; cut them into pieces where a provider takes less."""
    of = lambda name: table(spark, sf, name).dropDuplicates(["id"])
    rows = of("pages").where("content is not null").select(F.lit("page").alias("entity"), F.col("id").alias("key"), "content")
    whole = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    rows = rows.unionByName(of("legislative_items").select(F.lit("item").alias("entity"), F.col("id").alias("key"), whole.alias("content")))
    return rows.unionByName(of("public_comments").where("content is not null").select(F.lit("comment").alias("entity"), F.col("id").alias("key"), "content"))


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def set_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return merge.keep_last(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts, event_id) = 1")
def set_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return merge.keep_first(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


_AFTER = "select c_custkey + case when c_custkey % 11 = 0 then 1000000 else 0 end as k, c_name as name, case when c_custkey % 4 = 0 then c_acctbal + 1 else c_acctbal end as bal from customer where c_custkey % 2 = 0"
_BEFORE = "select c_custkey as k, c_name as name, c_acctbal as bal from customer"


def _states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer")
    old = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    new = c.where("c_custkey % 2 = 0").selectExpr("c_custkey + case when c_custkey % 11 = 0 then 1000000 else 0 end as k", "c_name as name", "case when c_custkey % 4 = 0 then c_acctbal + 1 else c_acctbal end as bal")
    return old, new


@query(f"with a as ({_BEFORE}), b as ({_AFTER}) select coalesce(a.k, b.k) as k, coalesce(b.name, a.name) as name, case when a.k is null then b.bal when b.k is null then a.bal else greatest(a.bal, b.bal) end as bal from a full join b on a.k = b.k")
def d_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _states(spark, sf)
    return merge.upsert(old, new, ["k"], {"bal": F.greatest})


@query(f"with a as ({_BEFORE}), b as ({_AFTER}) select * from a union all select * from b where k not in (select k from a)")
def d_insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return merge.insert_new(*_states(spark, sf), ["k"])


@query(f"with a as ({_BEFORE}), b as ({_AFTER}) select b.*, a.k is null as created from b left join a on a.k = b.k where a.k is null or a.name is distinct from b.name or a.bal is distinct from b.bal")
def d_change_detect(spark: SparkSession, sf: str) -> DataFrame:
    return merge.changed(*_states(spark, sf), ["k"], ["name", "bal"])


@query(f"with a as ({_BEFORE}), b as ({_AFTER}) select * from a where k not in (select k from b) union all select * from b")
def d_replace_children(spark: SparkSession, sf: str) -> DataFrame:
    return merge.replace_children(*_states(spark, sf), "k")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey in (select p_partkey from part where p_size < 25)")
def d_without_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return merge.without_orphans(table(spark, sf, "lineitem"), table(spark, sf, "part").where("p_size < 25"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("select o_orderkey, case when o_custkey % 10 = 0 then o_custkey + 1 else o_custkey end as o_custkey from orders")
def d_remap(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1).alias("new"))
    return merge.remap(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", m)


@query("select event_id, event_type, user_id from events where event_id > 1000 and event_type <> 'view' order by event_id limit 250")
def d_cursor_page(spark: SparkSession, sf: str) -> DataFrame:
    return feed.page(table(spark, sf, "events"), "event_id", 1000, 250, F.col("event_type") != "view").select("event_id", "event_type", "user_id")


@query(f"""
with a as ({_BEFORE}), b as ({_AFTER}) select 'customer' as entity_type, cast(coalesce(a.k, b.k) as varchar) as entity_key, case when a.k is null then 'create' when b.k is null then 'delete' else 'update' end as change_type
from a full join b on a.k = b.k where a.k is null or b.k is null or a.name is distinct from b.name or a.bal is distinct from b.bal""")
def d_change_log(spark: SparkSession, sf: str) -> DataFrame:
    return feed.changes(*_states(spark, sf), ["k"], "customer").drop("version")


@query("select event_id, row_number() over (order by ts, event_id) + 500 as seq from events")
def d_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return feed.numbered(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 500).select("event_id", "seq")


@query("""
with j as (select user_id, max(event_id) as length, arg_max(event_type, event_id) as etag, case when user_id % 3 = 0 then 'failed' else 'complete' end as status from events where event_id % 2 = 0 group by user_id),
p as (select user_id, max(event_id) as length, arg_max(event_type, event_id) as etag from events where event_id % 3 = 0 group by user_id)
select cast(coalesce(j.user_id, p.user_id) as varchar) as source_key, case when j.user_id is null then 'pending' when p.user_id is null then status when status = 'failed' then 'pending'
  when j.length <> p.length or j.etag <> p.etag then 'pending' else status end as status from j full join p on j.user_id = p.user_id""")
def d_job_transition(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    side = lambda rows: rows.groupBy("user_id").agg(F.max("event_id").alias("content_length"), F.max_by("event_type", "event_id").alias("etag")).withColumn("source_key", F.col("user_id").cast("string"))
    jobs = side(e.where("event_id % 2 = 0")).withColumn("status", F.when(F.col("user_id") % 3 == 0, "failed").otherwise("complete"))
    return feed.probe_states(jobs, side(e.where("event_id % 3 = 0"))).select("source_key", "status")


@query("""select event_id, user_id, event_type, value from events""")
def src14_json_recordset(spark: SparkSession, sf: str) -> DataFrame:
    """The events of each user, as one JSON array, come out as rows."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.to_json(F.collect_list(F.struct("event_id", "user_id", "event_type", "value"))).alias("j"))
    return records.recordset(e, "j", "event_id:bigint,user_id:bigint,event_type:string,value:double")


@query("select o_orderkey from orders where year(o_orderdate) = 1996 and o_orderstatus = 'O'")
def f_exact_year(spark: SparkSession, sf: str) -> DataFrame:
    """An exact year stands before a range."""
    rows = table(spark, sf, "orders")
    for c in conditions(1993, 1995, 1996, "O"):
        rows = rows.where(c)
    return rows.select("o_orderkey")


@query("""select time_bucket(interval 1 day, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def st_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: the batch result of the streaming plan."""
    from minutebook.streaming import feeds

    return feeds.tumbling(table(spark, sf, "events"), "ts", "1 day", "event_type")


@query("""
with a as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 30 minute then 1 else 0 end as s from events window w as (partition by user_id order by ts)),
b as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as g from a)
select user_id, min(ts) as session_start, count(*) as n from b group by user_id, g""")
def st_session(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: sessions with a gap of 30 minutes."""
    from minutebook.streaming import feeds

    return feeds.sessions(table(spark, sf, "events"), "ts", "30 minutes", "user_id")
