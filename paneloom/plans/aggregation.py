"""Grouped summaries and profiles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.numbers import encode
from ..operators import aggregates as ag
from ..operators import finance as fin
from .base import query
from .scalars import SQL_SCORE_RATIOS, SQL_Z, score_ratios
from .standins import GRADE_RANK, SQL_PANEL, SQL_RANK, SQL_RATINGS, SQL_STATEMENTS, panel, ratings



@query("ag1_group_stats", """
    select l_returnflag, l_linestatus, count(*) as n, cast(sum(l_quantity) as double) as quantity, round(avg(l_extendedprice), 4) as mean_price,
        min(l_discount) as min_discount, max(l_tax) as max_tax from lineitem group by 1, 2""")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"),
        F.min("l_discount").alias("min_discount"), F.max("l_tax").alias("max_tax"))


@query("ag2_duplicate_audit", """
    select o_custkey, cast(o_orderdate as date) as day, count(*) as n from orders group by 1, 2 having count(*) > 1""")
def _(t):
    return ag.duplicates(t.orders.select("o_custkey", F.to_date("o_orderdate").alias("day")), ["o_custkey", "day"])


@query("ag3_distinct_counts", """
    select cast(l_linenumber as varchar) as part, count(distinct l_suppkey) as suppliers, count(distinct l_partkey) as parts from lineitem group by 1
    union all select 'all', count(distinct l_suppkey), count(distinct l_partkey) from lineitem""")
def _(t):
    both = [F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts")]
    per = t.lineitem.groupBy(F.col("l_linenumber").cast("string").alias("part")).agg(*both)
    return per.union(t.lineitem.agg(*both).select(F.lit("all").alias("part"), "suppliers", "parts"))


@query("ag4_value_counts", """
    select o_orderstatus, o_orderpriority, count(*) as n, round(count(*) / sum(count(*)) over (), 8) as share from orders group by 1, 2""")
def _(t):
    return ag.value_counts(t.orders, "o_orderstatus", "o_orderpriority").withColumn("share", F.round("share", 8))


_PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("ag5_profile", "\nunion all ".join(f"""
    select '{c}' as variable, count({c}) as "count", round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, cast(min({c}) as double) as min,
        round(quantile_cont({c}, 0.25), 4) as p25, round(quantile_cont({c}, 0.5), 4) as p50, round(quantile_cont({c}, 0.75), 4) as p75,
        cast(max({c}) as double) as max from lineitem""" for c in _PROFILED))
def _(t):
    table = ag.profile(t.lineitem, _PROFILED)
    return table.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


_LEVELS = [0.0, 0.025, 0.1, 0.5, 0.9, 0.98, 1.0]


@query("ag6_quantiles", "\nunion all ".join(
    f"select 'value' as variable, cast({p} as double) as level, round(quantile_cont(value, {p}), 5) as value from events" for p in _LEVELS
) + "\nunion all " + "\nunion all ".join(
    f"select 'user_id', cast({p} as double), round(quantile_cont(cast(user_id as double), {p}), 5) from events" for p in _LEVELS))
def _(t):
    e = t.events.select("value", F.col("user_id").cast("double").alias("user_id"))
    return ag.quantile_table(e, {"value": _LEVELS, "user_id": _LEVELS}).withColumn("value", F.round("value", 5))


@query("ag7_collapse_values", """
    with x as (select o_custkey, o_orderdate, string_agg(distinct o_orderstatus, ', ' order by o_orderstatus) as s from orders group by 1, 2)
    select o_custkey, cast(o_orderdate as date) as day, case when s = 'F, O' then 'Both' else s end as sources from x""")
def _(t):
    rows = t.orders.select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    out = ag.collapse_values(rows, ["o_custkey", "day"], "o_orderstatus", "sources")
    return out.withColumn("sources", F.when(F.col("sources") == "F, O", "Both").otherwise(F.col("sources")))


@query("ag8_collect_list", """
    select n_regionkey, string_agg(n_name, ', ' order by n_nationkey) as nations from nation group by 1""")
def _(t):
    g = t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("_l"))
    return g.select("n_regionkey", F.array_join(F.transform("_l", lambda x: x["n_name"]), ", ").alias("nations"))


@query("ag9_crosstab", """
    select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as "F", count(*) filter (where o_orderstatus = 'O') as "O",
        count(*) filter (where o_orderstatus = 'P') as "P" from orders group by 1""")
def _(t):
    return ag.crosstab(t.orders, "o_orderpriority", "o_orderstatus")


_SPARSE = "select nullif(o_orderstatus, 'P') as status, case when o_totalprice > 100000 then o_totalprice end as price, o_custkey as customer from orders"


@query("ag10_missing", "\nunion all ".join(
    f"select '{c}' as variable, count(*) filter (where {c} is null) as n_missing, round(avg(case when {c} is null then 1.0 else 0.0 end), 6) as share_missing from ({_SPARSE})"
    for c in ("status", "price", "customer")))
def _(t):
    sparse = t.orders.select(
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"), F.col("o_custkey").alias("customer"))
    return ag.missing(sparse).withColumn("share_missing", F.round("share_missing", 6))


@query("ag11_correlations", "\nunion all ".join(
    f"select '{a}' as x, '{b}' as y, round(corr({a}, {b}), 6) as r from lineitem"
    for i, a in enumerate(_PROFILED) for b in _PROFILED[i:]))
def _(t):
    return ag.correlations(t.lineitem, _PROFILED).withColumn("r", F.round("r", 6))


@query("ag12_histogram", """
    with b as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders)
    select cast(least(floor((o_totalprice - lo) / ((hi - lo) / 20)) + 1, 20) as integer) as bin, count(*) as n from orders, b group by 1""")
def _(t):
    return ag.histogram(t.orders, "o_totalprice", 20)


@query("ag13_rates", """
    select o_orderpriority, count(*) as n_rows, count(*) filter (where o_totalprice > 200000) as n_large,
        round(avg(case when o_totalprice > 200000 then 1.0 else 0.0 end), 6) as share_large,
        count(*) filter (where o_orderstatus = 'F') as n_done, round(avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end), 6) as share_done
    from orders group by 1""")
def _(t):
    out = ag.rates(t.orders, {"large": F.col("o_totalprice") > 200000, "done": F.col("o_orderstatus") == "F"}, ["o_orderpriority"])
    return out.withColumns({c: F.round(c, 6) for c in ("share_large", "share_done")})


_PARTS = ["totalCurrentAssets", "totalLiabilities", "totalDebt", "revenue", "EBIT"]


@query("ag14_normalised_means", f"with {SQL_STATEMENTS}\n" + "\nunion all ".join(
    f"""select '{c}' as variable, count({c}) as "count", round(100 * avg({c}) / nullif(avg("totalAssets"), 0), 4) as percent from statements""" for c in _PARTS))
def _(t):
    from .standins import statements

    return ag.normalised_means(statements(t), _PARTS, "totalAssets").withColumn("percent", F.round("percent", 4))


@query("ag15_arg_extremes", """
    with o as (select o_orderstatus, o_orderkey, o_totalprice,
        row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as a,
        row_number() over (partition by o_orderstatus order by o_totalprice, o_orderkey) as b from orders)
    select o_orderstatus, max(case when a = 1 then o_orderkey end) as max_o_orderkey, max(case when a = 1 then o_totalprice end) as max_o_totalprice,
        max(case when b = 1 then o_orderkey end) as min_o_orderkey, max(case when b = 1 then o_totalprice end) as min_o_totalprice
    from o group by 1""")
def _(t):
    return ag.at_extremes(t.orders, "o_totalprice", "o_orderkey", ["o_orderkey", "o_totalprice"], ["o_orderstatus"])


@query("ag16_distinct", "select distinct l_suppkey, l_returnflag, l_linestatus from lineitem")
def _(t):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("ag17_two_key_means", f"""
    with m as (select c_mktsegment as sector, substr(o_orderpriority, 3) as grade, avg(o_totalprice) as m
        from orders join customer on o_custkey = c_custkey group by 1, 2)
    select sector, grade, round(m, 3) as mean_price, case grade when 'URGENT' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 end as code from m""")
def _(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy(F.col("c_mktsegment").alias("sector"), F.substring("o_orderpriority", 3, 100).alias("grade"))
    return g.agg(F.round(F.avg("o_totalprice"), 3).alias("mean_price")).withColumn("code", encode(F.col("grade"), GRADE_RANK))


@query("ag18_vector_mean", """
    select label, cast(i - 1 as integer) as component, round(avg(cast(embedding[i] as double)), 6) as mean
    from embeddings, range(1, 65) r(i) group by 1, 2""")
def _(t):
    pooled = ag.vector_mean(t.embeddings, ["label"], "embedding", 64)
    return pooled.select("label", F.posexplode("embedding").alias("component", "mean")).withColumn("mean", F.round("mean", 6))


@query("ag19_coverage", """
    select cast(year(o_orderdate) as integer) as year, cast(quarter(o_orderdate) as integer) as quarter, count(distinct o_custkey) as entities,
        count(*) as n_rows, concat(year(o_orderdate), 'Q', quarter(o_orderdate)) as label from orders group by 1, 2, 5""")
def _(t):
    return ag.coverage(t.orders, "o_orderdate", "o_custkey")


@query("ag20_outlier_cohort", f"""
    with {SQL_PANEL}, s as (select entity, period, rank, n, spend / 100000 as score, c_mktsegment as sector from panel join customer on entity = c_custkey),
    h as (select *, row_number() over (partition by entity, rank order by period, entity) as r from s where score > 6)
    select sector, count(*) as n_cases, round(avg(rank), 6) as mean_rank from h where r = 1 group by sector""")
def _(t):
    sector = t.customer.select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("sector"))
    scored = panel(t).withColumn("score", F.col("spend") / 100000)
    cases = ag.cohort_profile(scored, "score", 6, ["entity", "rank"], ["period"])
    return cases.join(sector, "entity").groupBy("sector").agg(F.count("*").alias("n_cases"), F.round(F.avg("rank"), 6).alias("mean_rank"))
