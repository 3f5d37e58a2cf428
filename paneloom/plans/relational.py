"""Sources, sinks, projections, filters, joins and set operations."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import strings as S
from ..functions.numbers import finite
from ..operators import filters as fl
from ..operators import joins as jn
from ..sources import readers as rd
from ..sources import writers as wr
from .base import query, scratch
from .standins import (
    END, GRID, SQL_FIRMS, SQL_GRID, SQL_PANEL, SQL_RATINGS, SQL_SHIPMENTS, firms, panel, ratings, shipments, sql_best_match,
)
from ..operators.windows import validity


# ---------------------------------------------------------------- sources


@query("src1_read_csv", """
    select c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as balance
    from customer group by c_mktsegment""")
def _(t):
    path = scratch(t, "src1")
    c = t.customer
    wr.write_csv(c, path)
    back = rd.drop_unnamed(rd.read_csv(t.spark, path, c.schema))
    return back.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("src2_read_parquet", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def _(t):
    return t.supplier


@query("src3_read_pieces", """
    select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total
    from orders group by o_orderstatus""")
def _(t):
    path = scratch(t, "src3")
    t.orders.repartition("o_orderkey").write.mode("overwrite").parquet(path)
    return rd.read_pieces(t.spark, path).groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("src4_pruned_read", """
    select l_returnflag, count(*) as n, cast(sum(l_quantity) as double) as quantity
    from lineitem group by l_returnflag""")
def _(t):
    slim = t.lineitem.select("l_returnflag", "l_quantity")
    return slim.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


# A tree of call files: one for each nation and quarter, in folders of region and nation.
_SQL_CALLS = """calls as (
    select trim(r_name) as sector, trim(n_name) as company, concat('N', n_nationkey) as symbol, year(o_orderdate) as year, quarter(o_orderdate) as quarter,
        max(o_orderkey) as last_key, count(*) as n, max(cast(o_orderdate as date)) as day
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    group by all)"""


def _calls(t):
    """The tree, written anew: every seventh file (by its last key) is cut before the transcript, every folder has a file of speakers."""
    c, n, r = t.customer.select("c_custkey", "c_nationkey"), t.nation, t.region
    rows = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(
        F.trim("r_name").alias("sector"), F.trim("n_name").alias("company"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("symbol"),
        F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"),
    ).agg(F.max("o_orderkey").alias("last_key"), F.count("*").alias("n"), F.max(F.to_date("o_orderdate")).alias("day"))
    folder = F.concat_ws("/", "sector", "company")
    whole = F.concat(F.lit(',0\ndate,'), F.col("day").cast("string"), F.lit(' 17:00\ncontent,"Operator: '), F.col("n").cast("string"),
                     F.lit(" orders, thank you.\nNext, the last is "), F.col("last_key").cast("string"), F.lit('."'))
    text = F.when(F.col("last_key") % 7 == 0, F.substring_index(whole, "\ncontent", 1)).otherwise(whole)
    calls = rows.select(F.concat(folder, F.lit("/"), "symbol", F.col("year").cast("string"), F.col("quarter").cast("string"), F.lit(".csv")).alias("file"), text.alias("value"))
    speakers = rows.select(F.concat(folder, F.lit("/speaker names.csv")).alias("file"), F.lit("name,firm").alias("value")).distinct()
    path = scratch(t, f"calls-{uuid.uuid4().hex}")
    wr.write_named_texts(calls.unionByName(speakers), path, "file", "value")
    return path


@query("src5_path_encoded", f"""
    with {_SQL_CALLS}
    select sector, company, symbol, cast(year as integer) as year, cast(quarter as integer) as quarter, concat(day, ' 17:00') as datetime,
        concat('Operator: ', n, ' orders, thank you.', chr(10), 'Next, the last is ', last_key, '.') as transcript
    from calls where last_key % 7 <> 0""")
def _(t):
    return rd.read_calls(t.spark, _calls(t))


@query("src6_tree_audit", f"""
    with {_SQL_CALLS} select sector, count(*) as n_raw, count(*) filter (where last_key % 7 <> 0) as n_ok from calls group by sector""")
def _(t):
    return fl.load_audit(rd.read_call_files(t.spark, _calls(t)), "sector", F.col("loaded"))


@query("src6_tolerant_load", """
    select event_type, count(*) as n_raw, count(*) filter (where value >= 50) as n_ok
    from events group by event_type""")
def _(t):
    path = scratch(t, "src6")
    text = F.when(F.col("value") >= 50, F.floor("value").cast("string")).otherwise(F.concat(F.lit("?"), "value"))
    wr.write_csv(t.events.select("event_type", text.alias("value")), path)
    loaded = rd.read_tolerant(t.spark, path, StructType.fromDDL("event_type string, value long"))
    return fl.load_audit(loaded, "event_type", ~F.col("_bad"))


@query("src7_nested_json", """
    select c_custkey, c_acctbal * 2 as balance, cast(c_nationkey as double) as nation, cast(null as double) as absent
    from customer""")
def _(t):
    entry = lambda label, v: F.struct(F.lit(label).alias("label"), v.cast("double").alias("value"))
    doc = F.to_json(F.struct(F.struct(
        F.array(entry("balance", F.col("c_acctbal")), entry("balance", F.col("c_acctbal") * 2)).alias("bs"),
        F.array(entry("nation", F.col("c_nationkey"))).alias("ic")).alias("data")))
    parsed = t.customer.select("c_custkey", doc.alias("doc")).withColumn(
        "d", rd.json_field(F.col("doc"), f"data {rd.ENTRY_SCHEMA}", "data"))
    return parsed.select(
        "c_custkey",
        rd.labelled_value(F.col("d.bs"), "balance").alias("balance"),
        rd.labelled_value(F.col("d.ic"), "nation").alias("nation"),
        rd.labelled_value(F.col("d.bs"), "nation").alias("absent"))


@query("src8_score_shards", """
    with f as (select min(event_id) as first from events)
    select event_id - first as position, case when event_id % 11 <> 0 then value end as score from events, f""")
def _(t):
    # Shards of uneven length: the k-th holds 100 * (2k + 1) events; some lines hold no number.
    first = t.events.agg(F.min("event_id")).scalar()
    at = (F.col("event_id") - first).alias("at")
    shard = F.floor(F.sqrt(at / 100)).cast("long")
    text = F.when(F.col("event_id") % 11 != 0, F.col("value").cast("string")).otherwise("n/a")
    start, end = (100 * F.pow("shard", 2)).cast("long"), (100 * F.pow(F.col("shard") + 1, 2)).cast("long")
    rows = t.events.select(at, shard.alias("shard"), text.alias("value"))
    rows = rows.select("at", "value", F.concat_ws("_", F.lit("result"), start.cast("string"), F.concat(end.cast("string"), F.lit(".txt"))).alias("file"))
    path = scratch(t, f"src8-{uuid.uuid4().hex}")
    wr.write_named_texts(rows, path, "file", "value", ["at"])
    return rd.read_score_shards(t.spark, path)


# ---------------------------------------------------------------- sinks


@query("snk1_write_parquet", """
    select o_orderstatus, count(*) as n, min(o_orderkey) as first_key, max(o_orderkey) as last_key
    from orders group by o_orderstatus""")
def _(t):
    path = scratch(t, "snk1")
    wr.write_parquet(t.orders, path, by=["o_orderstatus"])
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("snk2_write_csv", """
    select lang, count(*) as n, cast(sum(length(text)) as bigint) as chars from documents group by lang""")
def _(t):
    path = scratch(t, "snk2")
    docs = t.documents.select("doc_id", "lang", "text")
    wr.write_csv(docs, path)
    return rd.read_csv(t.spark, path, docs.schema, multi_line=True).groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("snk3_write_pieces", """
    with pos as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as p, count(*) over () as n from orders),
    cuts as (select cast(unnest(range(7)) as bigint) as piece)
    select cast(piece as integer) as piece, count(*) as n_rows, min(o_orderkey) as first_key, max(o_orderkey) as last_key
    from pos join cuts on p >= (piece * n) // 7 and p < ((piece + 1) * n) // 7 group by piece""")
def _(t):
    path = scratch(t, "snk3")
    wr.write_pieces(t.orders, path, ["o_orderkey"], 7)
    return t.spark.read.parquet(path).groupBy("piece").agg(
        F.count("*").alias("n_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("snk4_stable_sample", """
    select o_orderkey, o_custkey, o_orderstatus from orders order by md5('7|' || o_orderkey), o_orderkey limit 100""")
def _(t):
    return wr.stable_sample(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], 100, seed=7)


@query("snk5_metric_log", """
    select event_type as name, arg_max(cast(user_id as varchar), event_id) as value, count(*) as writes,
        case when count(*) = 1 then 'newcommand' else 'renewcommand' end as command
    from events group by event_type""")
def _(t):
    path = scratch(t, "snk5")
    log = t.events.select(
        F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("value"), F.col("event_id").alias("seq"))
    log.write.mode("overwrite").parquet(path)
    return wr.latest_metrics(t.spark.read.parquet(path))


@query("snk6_slim_extract", "select doc_id, lang, source, n_chars from documents")
def _(t):
    path = scratch(t, "snk6")
    wr.write_parquet(wr.slim(t.documents, "text"), path)
    return t.spark.read.parquet(path)


# ---------------------------------------------------------------- projections


@query("prj1_select_rename", """
    select c_custkey as entity, c_name as name, c_mktsegment as sector from customer""")
def _(t):
    names = {"c_custkey": "entity", "c_name": "name", "c_mktsegment": "sector"}
    return t.customer.select(*names).withColumnsRenamed(names)


@query("prj2_drop_columns", "select p_partkey, p_brand, p_size from part")
def _(t):
    return t.part.drop("p_name", "p_type", "p_retailprice", "not_there")


def _flag_totals(t):
    sums = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return {flag: sums(flag) for flag in ("A", "N", "R")}


@query("prj3_suffix_shared", """
    select a.l_suppkey, a.n as n_A, a.total as total_A, r.n as n_R, r.total as total_R
    from (select l_suppkey, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem where l_returnflag = 'A' group by 1) a
    join (select l_suppkey, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem where l_returnflag = 'R' group by 1) r
      on a.l_suppkey = r.l_suppkey""")
def _(t):
    sides = _flag_totals(t)
    a, r = jn.suffix_shared({"A": sides["A"], "R": sides["R"]}, ["l_suppkey"]).values()
    return a.join(r, "l_suppkey")


@query("prj4_provenance", """
    select c_custkey as id, 'customer' as source, c_acctbal as balance from customer""")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("source"), F.col("c_acctbal").alias("balance"))


@query("prj5_composite_key", f"""
    with {SQL_PANEL}, keyed as (select concat(entity, ' : ', period) as node from panel)
    select node, split_part(node, ' : ', 1) as entity, cast(split_part(node, ' : ', 2) as date) as period from keyed""")
def _(t):
    node = F.concat_ws(" : ", F.col("entity").cast("string"), F.col("period").cast("string"))
    parts = F.split("node", " : ")
    return panel(t).select(node.alias("node")).select(
        "node", parts[0].alias("entity"), F.to_date(parts[1]).alias("period"))


@query("prj6_align_and_union", """
    select c_custkey as id, c_name as name, c_mktsegment as segment, c_acctbal as balance from customer
    union all select s_suppkey, s_name, null, s_acctbal from supplier""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                          F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    s = t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return c.unionByName(s, allowMissingColumns=True)


# ---------------------------------------------------------------- filters


@query("flt1_ranges", """
    select o_orderkey, year(o_orderdate) * 10 + quarter(o_orderdate) as code, o_totalprice from orders
    where o_totalprice between 100000 and 300000 and o_orderdate >= date '1996-06-01'
      and year(o_orderdate) * 10 + quarter(o_orderdate) between 19963 and 19982""")
def _(t):
    code = F.year("o_orderdate") * 10 + F.quarter("o_orderdate")
    rows = t.orders.where(F.col("o_totalprice").between(100000, 300000) & (F.col("o_orderdate") >= F.lit("1996-06-01").cast("timestamp_ntz")))
    return rows.select("o_orderkey", code.cast("long").alias("code"), "o_totalprice").where(F.col("code").between(19963, 19982))


@query("flt2_text_match", """
    select p_partkey, p_name, contains(p_name, 'ring') as has_ring, starts_with(p_name, 'blue') as is_blue,
        coalesce(contains(nullif(p_type, 'SMALL'), 'CON'), false) as econ
    from part where lower(p_name) like '%widget%' or contains(p_name, 'ring')""")
def _(t):
    name = F.col("p_name")
    typed = F.nullif(F.col("p_type"), F.lit("SMALL"))
    return t.part.where(S.matches(name.ilike("%WIDGET%") | name.contains("ring"))).select(
        "p_partkey", "p_name", S.matches(name.contains("ring")).alias("has_ring"),
        S.matches(name.startswith("blue")).alias("is_blue"), S.matches(typed.contains("CON")).alias("econ"))


@query("flt3_block_list", """
    select c_custkey, c_mktsegment from customer where c_mktsegment not in ('HOUSEHOLD', 'MACHINERY')""")
def _(t):
    return t.customer.select("c_custkey", "c_mktsegment").where(~F.col("c_mktsegment").isin("HOUSEHOLD", "MACHINERY"))


@query("flt4_negated_compound", f"""
    with {SQL_PANEL}
    select entity, period, rank from panel where not coalesce(rank = 4 and period > date '1998-03-03', false)""")
def _(t):
    keep = fl.not_both(F.col("rank") == 4, F.col("period") > F.lit(date(1998, 3, 3)))
    return panel(t).where(keep).select("entity", "period", "rank")


def _three_dates(t):
    q = lambda c: F.trunc(F.to_date(c), "quarter")
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("first"),
        F.max(F.when(F.col("l_returnflag") != "N", F.col("l_shipdate"))).alias("last"))
    o = t.orders.select("o_orderkey", q("o_orderdate").alias("filed_1"))
    return o.join(lines, o.o_orderkey == lines.l_orderkey).select(
        "o_orderkey", "filed_1", q("first").alias("filed_2"), q("last").alias("filed_3"))


SQL_THREE = """three as (
    select o_orderkey, cast(date_trunc('quarter', o_orderdate) as date) as filed_1,
        cast(date_trunc('quarter', min(l_shipdate)) as date) as filed_2,
        cast(date_trunc('quarter', max(case when l_returnflag <> 'N' then l_shipdate end)) as date) as filed_3
    from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderdate)"""


@query("flt5_agreement", f"""
    with {SQL_THREE} select o_orderkey, filed_1 as filed from three where filed_1 = filed_2 and filed_1 = filed_3""")
def _(t):
    return fl.agree(_three_dates(t), ["filed_1", "filed_2", "filed_3"], "filed")[0]


@query("flt5_agreement_audit", f"""
    with {SQL_THREE}
    select count(*) as n_rows, count(*) filter (where not ok) as n_disagree,
        round(avg(case when ok then 0.0 else 1.0 end), 6) as share_disagree
    from (select coalesce(filed_1 = filed_2 and filed_1 = filed_3, false) as ok from three)""")
def _(t):
    audit = fl.agree(_three_dates(t), ["filed_1", "filed_2", "filed_3"], "filed")[1]
    return audit.withColumn("share_disagree", F.round("share_disagree", 6))


@query("flt6_date_window", """
    select l_orderkey, l_linenumber, l_partkey, cast(l_shipdate as date) as ship_day from lineitem join orders on l_orderkey = o_orderkey
    where cast(l_shipdate as date) between cast(date_trunc('quarter', o_orderdate) as date)
          and cast(date_trunc('quarter', o_orderdate) + interval 3 month as date)
      and datediff('day', cast(o_orderdate as date), cast(l_shipdate as date)) <= 45""")
def _(t):
    o = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("ship_day"))
    start = F.trunc("day", "quarter")
    keep = fl.in_window(F.col("ship_day"), start, F.add_months(start, 3), F.col("day"), 45)
    return li.join(o, li.l_orderkey == o.o_orderkey).where(keep).select("l_orderkey", "l_linenumber", "l_partkey", "ship_day")


def _gappy(t):
    return t.orders.select(
        "o_orderkey",
        F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("price"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("customer"))


SQL_GAPPY = """gappy as (select o_orderkey, case when o_totalprice >= 50000 then o_totalprice end as price,
    nullif(o_orderstatus, 'P') as status, case when o_custkey % 10 <> 0 then o_custkey end as customer from orders)"""


@query("flt7_complete_cases", f"""
    with {SQL_GAPPY} select * from gappy where price is not null and status is not null and customer is not null""")
def _(t):
    return fl.complete_cases(_gappy(t), ["price", "status", "customer"])[0]


@query("flt7_complete_cases_audit", f"""
    with {SQL_GAPPY}, steps as (select case when price is null then 1 when status is null then 2 when customer is null then 3 end as step from gappy)
    select step, case step when 1 then 'price' when 2 then 'status' else 'customer' end as "column", count(*) as rows_lost
    from steps where step is not null group by step""")
def _(t):
    return fl.complete_cases(_gappy(t), ["price", "status", "customer"])[1]


@query("flt8_outliers", """
    with ok as (select event_id, user_id, value from events where value <= 300 and user_id <> 7)
    select * from ok where event_id <> (select event_id from ok order by value desc, event_id limit 1)""")
def _(t):
    ok = t.events.where((F.col("value") <= 300) & (F.col("user_id") != 7)).select("event_id", "user_id", "value")
    return fl.drop_extreme(ok, "value", "event_id")


@query("flt9_finite", """
    select l_linenumber, count(*) as n, count(case when l_quantity <> 25 then 1 end) as n_finite,
        round(sum(case when l_quantity <> 25 then 1.0 / (l_quantity - 25) end), 4) as total
    from lineitem group by l_linenumber""")
def _(t):
    gap = F.col("l_quantity") - 25
    raw = F.when(gap == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), gap))
    x = t.lineitem.select("l_linenumber", finite(raw).alias("x"))
    return x.groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.count("x").alias("n_finite"), F.round(F.sum("x"), 4).alias("total"))


@query("flt10_expression", """
    select p_partkey, p_brand, p_size from part where (p_size > 40 or p_brand = 'Brand#2') and p_retailprice < 1000""")
def _(t):
    return t.part.where("(p_size > 40 or p_brand = 'Brand#2') and p_retailprice < 1000").select("p_partkey", "p_brand", "p_size")


@query("flt11_incremental", """
    select doc_id, n_chars from documents where doc_id not in (select doc_id from labels)""")
def _(t):
    return fl.pending(t.documents.select("doc_id", "n_chars"), t.labels, ["doc_id"])


# ---------------------------------------------------------------- joins

SQL_SHIP_QUARTERS = """ship_quarters as (
    select o_custkey as entity, cast(date_trunc('quarter', l_shipdate) as date) as period,
        count(*) as lines, cast(sum(l_quantity) as double) as quantity
    from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)"""


def ship_quarters(t):
    s = shipments(t).withColumn("period", F.trunc("ship_day", "quarter"))
    return s.groupBy("entity", "period").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))


@query("jn1_inner_join", f"""
    with {SQL_PANEL}, {SQL_SHIP_QUARTERS}
    select p.entity, p.period, n, spend, lines, quantity from panel p join ship_quarters s on p.entity = s.entity and p.period = s.period""")
def _(t):
    p = panel(t).select("entity", "period", "n", "spend")
    return p.join(ship_quarters(t), ["entity", "period"])


@query("jn2_left_join", """
    select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey
    left join region on n_regionkey = r_regionkey and r_regionkey <> 2""")
def _(t):
    n, r = t.nation, t.region.where("r_regionkey <> 2")
    return (
        t.customer.join(n, F.col("c_nationkey") == n.n_nationkey, "left")
        .join(r, F.col("n_regionkey") == r.r_regionkey, "left")
        .select("c_custkey", "n_name", "r_name"))


@query("jn3_fold_inner", """
    with f as (select l_suppkey, l_returnflag as flag, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem group by 1, 2)
    select a.l_suppkey, a.n as n_A, a.total as total_A, n.n as n_N, n.total as total_N, r.n as n_R, r.total as total_R
    from f a join f n on a.l_suppkey = n.l_suppkey join f r on a.l_suppkey = r.l_suppkey
    where a.flag = 'A' and n.flag = 'N' and r.flag = 'R'""")
def _(t):
    return jn.fold_inner(_flag_totals(t), ["l_suppkey"])


@query("jn4_full_outer_flags", """
    with a as (select distinct o_custkey as entity from orders where o_orderdate < date '1998-07-01'),
         b as (select distinct o_custkey as entity from orders where o_orderdate >= date '1998-07-01')
    select coalesce(a.entity, b.entity) as entity, case when a.entity is null then 0 else 1 end as early,
        case when b.entity is null then 0 else 1 end as late
    from a full join b on a.entity = b.entity""")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("entity"), "o_orderdate")
    early = o.where("o_orderdate < timestamp_ntz '1998-07-01'").select("entity").distinct()
    late = o.where("o_orderdate >= timestamp_ntz '1998-07-01'").select("entity").distinct()
    return jn.flagged_full_join(early, late, ["entity"], ("early", "late"))


@query("jn5_anti_join", "select doc_id, source from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def _(t):
    return t.documents.select("doc_id", "source").join(t.labels.where("toxic = 1"), "doc_id", "left_anti")


@query("jn6_semi_join", """
    with edges as (select distinct l_suppkey as src, l_partkey as dst from lineitem)
    select s_suppkey as node, s_name from supplier
    where s_suppkey in (select src from edges) or s_suppkey in (select dst from edges)""")
def _(t):
    e = t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return jn.in_either_end(t.supplier.select(F.col("s_suppkey").alias("node"), "s_name"), e.distinct())


SQL_HISTORY = f"""{SQL_RATINGS}, history as (
    select *, coalesce(lead(day) over (partition by agency, entity order by day, tie), date '2001-12-31') as valid_to from ratings)"""


def history(t):
    return validity(ratings(t), ["agency", "entity"], ["day", "tie"], END)


@query("jn7_interval_join", f"""
    with {SQL_HISTORY}, {SQL_GRID}
    select agency, entity, day, valid_to, grade, tie, grid_date from history join grid on day <= grid_date and grid_date < valid_to""")
def _(t):
    return jn.interval_join(history(t), "day", "valid_to", GRID).select(
        "agency", "entity", "day", "valid_to", "grade", "tie", "grid_date")


@query("jn7_interval_join_closed", f"""
    with {SQL_HISTORY}, {SQL_GRID}
    select agency, entity, tie, grid_date from history join grid on day <= grid_date and grid_date <= valid_to""")
def _(t):
    return jn.interval_join(history(t), "day", "valid_to", GRID, closed="both").select("agency", "entity", "tie", "grid_date")


@query("jn8_asof_join", f"""
    with {SQL_HISTORY}, {SQL_GRID}, {SQL_SHIPMENTS},
    status as (select agency, entity, tie, grid_date from history join grid on day <= grid_date and grid_date < valid_to),
    latest as (
        select status.*, ship_day, l_orderkey, row_number() over (partition by agency, status.entity, tie, grid_date
            order by ship_day desc, l_orderkey desc, l_linenumber desc, l_partkey desc) as r
        from status join shipments s on s.entity = status.entity and ship_day < grid_date and ship_day >= grid_date - interval 3 month)
    select agency, entity, tie, grid_date, ship_day, l_orderkey from latest where r = 1""")
def _(t):
    status = jn.interval_join(history(t), "day", "valid_to", GRID).select("agency", "entity", "tie", "grid_date")
    events = shipments(t).select("entity", "ship_day", "l_orderkey", "l_linenumber", "l_partkey")
    out = jn.asof_join(status, events, ["entity"], "grid_date", "ship_day", ["l_orderkey", "l_linenumber", "l_partkey"], GRID)
    return out.select("agency", "entity", "tie", "grid_date", "ship_day", "l_orderkey")


@query("jn9_match_not_self", f"""
    with {SQL_FIRMS}
    select a.doc_id as id, b.doc_id as other, a.name from firms a join firms b on a.name = b.name and a.k = 2 and b.k = 2 and a.doc_id <> b.doc_id""")
def _(t):
    f = firms(t).where("k = 2")
    other = f.select(F.col("doc_id").alias("other"), F.col("name").alias("other_name"))
    return jn.match_not_self(f.select(F.col("doc_id").alias("id"), "name"), other, ("name", "other_name"), ("id", "other")).select("id", "other", "name")


@query("jn10_keys_by_grid", f"""
    with {SQL_GRID} select c_custkey, grid_date from customer, grid""")
def _(t):
    return t.customer.select("c_custkey", F.explode(GRID.points()).alias("grid_date"))


@query("jn11_previous_period", f"""
    with {SQL_PANEL}
    select a.entity, a.period, a.spend, round(a.spend - b.spend, 2) as spend_diff, a.n - b.n as n_diff
    from panel a left join panel b on a.entity = b.entity and a.previous = b.period""")
def _(t):
    out = jn.previous_period(panel(t), "entity", "period", "previous", ["spend", "n"])
    return out.select("entity", "period", "spend", F.round("spend_diff", 2).alias("spend_diff"), "n_diff")


@query("jn12_lookup_ends", """
    with edges as (select distinct c_nationkey as src, s_nationkey as dst
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)
    select src, dst, a.n_name as src_n_name, b.n_name as dst_n_name from edges
    left join nation a on src = a.n_nationkey left join nation b on dst = b.n_nationkey""")
def _(t):
    li, o = t.lineitem.select("l_orderkey", "l_suppkey"), t.orders.select("o_orderkey", "o_custkey")
    c, s = t.customer.select("c_custkey", "c_nationkey"), t.supplier.select("s_suppkey", "s_nationkey")
    edges = (
        li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
        .join(s, li.l_suppkey == s.s_suppkey)
        .select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct())
    return jn.lookup_ends(edges, t.nation.select("n_nationkey", "n_name"), "n_nationkey")


# Listed names: one letter of every firm is dropped.
@query("jn13_fuzzy_best_match", f"""
    with {SQL_FIRMS}, listed as (select concat(substr(name, 1, 4), substr(name, 6)) as name from firms),
    {sql_best_match("firms", "listed", "firm", "listed_name", 0.7)}""")
def _(t):
    f = firms(t)
    listed = f.select(F.concat(F.substring("name", 1, 4), F.expr("substr(name, 6)")).alias("listed_name"))
    out = jn.fuzzy_best_match(f.select(F.col("name").alias("firm")), listed, "firm", "listed_name", threshold=0.7)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("jn14_key_coverage", """
    with a as (select doc_id, count(*) as n from documents group by 1), b as (select doc_id, count(*) as n from labels group by 1)
    select count(a.doc_id) as left_keys, count(b.doc_id) as right_keys, count(case when a.doc_id = b.doc_id then 1 end) as common_keys,
        max(a.n) <= 1 as left_unique, max(b.n) <= 1 as right_unique
    from a full join b on a.doc_id = b.doc_id""")
def _(t):
    return jn.key_coverage(t.documents, t.labels, "doc_id")


@query("jn15_aligned_predictions", """
    select doc_id, quality as truth, case when n_chars > 1500 then 1 else 0 end as prediction_1,
        case when lang = 'en' then 1 else 0 end as prediction_2
    from labels join documents using (doc_id)""")
def _(t):
    from ..operators.metrics import aligned

    d = t.labels.join(t.documents.select("doc_id", "n_chars", "lang"), "doc_id").withColumnRenamed("quality", "truth")
    one = d.withColumn("prediction", F.when(F.col("n_chars") > 1500, 1).otherwise(0))
    two = d.withColumn("prediction", F.when(F.col("lang") == "en", 1).otherwise(0))
    return aligned(one, two, ["doc_id"])


# ---------------------------------------------------------------- set operations


@query("so1_union_all", """
    select l_suppkey as id, 'line' as kind from lineitem
    union all select s_suppkey, 'supplier' from supplier""")
def _(t):
    a = t.lineitem.select(F.col("l_suppkey").alias("id"), F.lit("line").alias("kind"))
    b = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b)


@query("so2_symmetrised_edges", """
    with e as (select distinct o_custkey as src, l_suppkey as dst from lineitem join orders on l_orderkey = o_orderkey)
    select src, dst from e union select dst, src from e""")
def _(t):
    from ..operators.graph import symmetrise

    li, o = t.lineitem, t.orders
    e = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return symmetrise(e.distinct())


@query("so3_key_sets", """
    with a as (select distinct o_custkey as k from orders where o_orderstatus = 'F'),
         b as (select distinct o_custkey as k from orders where o_orderstatus = 'P')
    select 'both' as part, count(*) as n from (select k from a intersect select k from b)
    union all select 'only_a', count(*) from (select k from a except select k from b)
    union all select 'only_b', count(*) from (select k from b except select k from a)""")
def _(t):
    keys = lambda s: t.orders.where(
        F.col("o_orderstatus") == s).select("o_custkey").distinct()
    a, b = keys("F"), keys("P")
    size = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return size(a.intersect(b), "both").union(size(a.subtract(b), "only_a")).union(size(b.subtract(a), "only_b"))


@query("so4_append_columns", """
    select doc_id, n_chars, quality, toxic from documents left join labels using (doc_id)""")
def _(t):
    return t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
