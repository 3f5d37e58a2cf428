"""Window functions over histories and panels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window, functions as F

from ..functions.numbers import ratio
from ..operators import text as tx
from ..operators import windows as wn
from ..functions.arrays import longest_run
from .base import query
from .standins import END, SQL_PANEL, SQL_RATINGS, SQL_TOKEN, SQL_WORD, panel, ratings, sql_words

KEY, ORDER = ["agency", "entity"], ["day", "tie"]
_W = "over (partition by agency, entity order by day, tie)"


@query("wn1_lead_and_lag", f"""
    with {SQL_RATINGS}
    select agency, entity, day, tie, grade, lead(grade) {_W} as next_grade, lead(day) {_W} as next_day,
        lag(grade) {_W} as previous_grade, lag(day) {_W} as previous_day from ratings""")
def _(t):
    out = wn.neighbours(ratings(t), KEY, ORDER, ["grade", "day"], ["grade", "day"])
    return out.select(*KEY, *ORDER, "grade", "next_grade", "next_day", "previous_grade", "previous_day")


@query("wn2_close_interval", f"""
    with {SQL_RATINGS} select agency, entity, day, tie, coalesce(lead(day) {_W}, date '2001-12-31') as valid_to from ratings""")
def _(t):
    return wn.validity(ratings(t), KEY, ORDER, END).select(*KEY, *ORDER, "valid_to")


_SQL_TYPED = f"""{SQL_RATINGS}, typed as (
    select *, lag(grade) {_W} as pg, lag(rank) {_W} as pr, lag(1) {_W} as before from ratings),
    kinds as (select *, case when before is null then 'Ambiguous' when grade is not distinct from pg then 'Affirmation' when rank > pr then 'Upgrade'
        when rank < pr then 'Downgrade' else 'Change' end as kind from typed)"""


def _typed(t):
    out = wn.neighbours(ratings(t), KEY, ORDER, previous=["grade", "rank"], flag="has_previous")
    return out.withColumn("kind", wn.event_type(first=~F.col("has_previous")))


@query("wn3_event_type", f"with {_SQL_TYPED} select agency, entity, tie, grade, kind from kinds")
def _(t):
    return _typed(t).select(*KEY, "tie", "grade", "kind")


@query("wn4_signed_step", f"""
    with {_SQL_TYPED} select agency, entity, tie, kind, case when kind = 'Affirmation' then 0 when kind in ('Upgrade', 'Downgrade') then rank - pr end as step from kinds""")
def _(t):
    return _typed(t).select(*KEY, "tie", "kind", wn.signed_step(F.col("kind")).alias("step"))


@query("wn5_row_lag", f"""
    with {SQL_PANEL} select entity, period, rank, lag(rank) over (partition by entity order by period) as previous_rank from panel""")
def _(t):
    w = Window.partitionBy("entity").orderBy("period")
    return panel(t).select("entity", "period", "rank", F.lag("rank").over(w).alias("previous_rank"))


# The labels of a change.
LABELS = ("Downgrade Since Last Fixed Quarter Date", "Upgrade Since Last Fixed Quarter Date", "Same As Last Fixed Quarter Date")


@query("wn6_direction", f"""
    with {SQL_PANEL}, l as (select entity, period, rank, lag(rank) over (partition by entity order by period) as before from panel)
    select entity, period, case when rank < before then '{LABELS[0]}' when rank > before then '{LABELS[1]}' when rank = before then '{LABELS[2]}' end as direction,
        rank - before as change from l""")
def _(t):
    w = Window.partitionBy("entity").orderBy("period")
    lagged = panel(t).withColumn("before", F.lag("rank").over(w))
    return lagged.select("entity", "period", wn.direction(F.col("rank"), F.col("before"), LABELS).alias("direction"),
                         (F.col("rank") - F.col("before")).alias("change"))


@query("wn7_fill_forward", """
    with daily as (select user_id, cast(ts as date) as day, arg_max(value, (ts, event_id)) as value from events
        where cast(ts as date) between date '2024-01-01' and date '2024-01-31' group by 1, 2),
    grid as (select user_id, cast(unnest(generate_series(date '2024-01-01', date '2024-01-31', interval 1 day)) as date) as day from (select distinct user_id from daily)),
    filled as (select g.user_id, g.day, last_value(value ignore nulls) over (partition by g.user_id order by g.day rows unbounded preceding) as value
        from grid g left join daily d on g.user_id = d.user_id and g.day = d.day)
    select * from filled where value is not null""")
def _(t):
    return wn.fill_forward(t.events, "user_id", "ts", "value", date(2024, 1, 1), date(2024, 1, 31), ["event_id"])


@query("wn8_group_statistic", """
    select l_orderkey, l_linenumber, l_partkey, l_quantity, max(l_quantity) over (partition by l_suppkey) as top_quantity,
        cast(sum(l_quantity) over (partition by l_suppkey) as double) as sum_quantity from lineitem""")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey")
    return wn.group_stat(li, ["l_suppkey"], top_quantity=F.max("l_quantity"), sum_quantity=F.sum("l_quantity")).drop("l_suppkey")


@query("wn9_precedence_dedupe", """
    with a as (select *, row_number() over (partition by user_id, cast(ts as date), event_type order by user_id % 2 desc, ts desc, event_id desc) as r from events),
    b as (select *, row_number() over (partition by user_id, cast(ts as date) order by case event_type when 'purchase' then 0 when 'signup' then 1 else 2 end, ts desc, event_id desc) as q
        from a where r = 1)
    select user_id, cast(ts as date) as day, event_id, event_type from b where q = 1""")
def _(t):
    e = t.events.withColumn("day", F.to_date("ts"))
    one = wn.first_per_key(e, ["user_id", "day", "event_type"], [F.desc(F.col("user_id") % 2), F.desc("ts"), F.desc("event_id")])
    prio = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    two = wn.first_per_key(one, ["user_id", "day"], [prio, F.desc("ts"), F.desc("event_id")])
    return two.select("user_id", "day", "event_id", "event_type")


@query("wn10_top_k", """
    select * from (select o_custkey, o_orderkey, o_totalprice, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as integer) as rank from orders) where rank <= 3""")
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return wn.top_per_group(rows, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)


@query("wn11_average_rank", """
    select p_partkey, p_brand, p_size, cast(floor(rank() over (partition by p_brand order by p_size desc) + (count(*) over (partition by p_brand, p_size) - 1) / 2.0) as bigint) as rank from part""")
def _(t):
    return wn.average_rank(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size")


@query("wn12_last_row", """
    select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1""")
def _(t):
    last = wn.first_per_key(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.select("user_id", "event_id", "event_type", "value")


_SQL_ATTRITION = f"""{SQL_PANEL}, gone as (select entity, max(period) as last_period from panel group by 1
    having max(period) < (select max(period) from panel))"""


@query("wn13_attrition_history", f"""
    with {_SQL_ATTRITION} select p.entity, p.period, p.n from panel p where entity in (select entity from gone)""")
def _(t):
    p = panel(t)
    return p.join(wn.attrition(p, "entity", "period"), "entity", "left_semi").select("entity", "period", "n")


@query("wn13_attrition_share", f"""
    with {_SQL_ATTRITION} select (select count(*) from gone) as n_gone, count(distinct entity) as n_entities,
        round((select count(*) from gone) / count(distinct entity), 6) as share from panel""")
def _(t):
    p = panel(t)
    gone = wn.attrition(p, "entity", "period").agg(F.count("*")).scalar()
    return p.agg(F.countDistinct("entity").alias("n_entities")).select(
        gone.alias("n_gone"), "n_entities", F.round(ratio(gone, F.col("n_entities")), 6).alias("share"))


@query("wn14_longest_run", f"""
    with w as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select doc_id, {sql_words()} as ws from documents)),
    f as (select doc_id, i, i - row_number() over (partition by doc_id order by i) as island from w where regexp_matches(w, $$^\\p{{Lu}}$$))
    select d.doc_id, cast(coalesce(max(n), 0) as integer) as run from documents d
    left join (select doc_id, island, count(*) as n from f group by 1, 2) r on d.doc_id = r.doc_id group by d.doc_id""")
def _(t):
    ws = tx.words(tx.tokens(F.col("text")))
    docs = t.documents.select("doc_id", "text").select("doc_id", ws.alias("ws"))
    return docs.select("doc_id", longest_run(F.col("ws"), lambda w: w.rlike(tx.CAPITALISED)).alias("run"))
