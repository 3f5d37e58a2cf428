"""End-to-end jobs: the status panel and the cleaned statement panel."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.dates import MonthGrid
from ..functions.numbers import at_least
from ..operators import finance as fin
from ..operators import joins as jn
from ..operators import windows as wn
from ..session import stored
from .base import query
from .relational import SQL_HISTORY, history
from .scalars import SQL_CLIPPED, SQL_FAMILY, SQL_SCORE_RATIOS, SQL_Z, family, score_ratios
from .standins import GRID, SQL_GRID, SQL_PANEL, SQL_SHIPMENTS, SQL_STATEMENTS, panel, shipments
from .temporal import LABELS

# Status of every customer on each quarter start, its change since the previous quarter
# in the panel and the latest shipment before it. A customer may be rated by several
# agencies on a date: the best grade counts, the larger key on a tie.
SQL_STATUS = f"""{SQL_HISTORY}, {SQL_GRID}, {SQL_SHIPMENTS},
    status as (
        select entity, grid_date, grade, rank, row_number() over (partition by entity, grid_date order by rank desc nulls last, agency, tie desc) as r
        from history join grid on day <= grid_date and grid_date < valid_to),
    ships as (
        select entity, cast(date_trunc('quarter', ship_day) + interval 3 month as date) as grid_date, max(ship_day) as ship_day from shipments group by 1, 2),
    dated as (select s.entity, s.grid_date, s.grade, s.rank, ship_day from status s join ships p on s.entity = p.entity and s.grid_date = p.grid_date where r = 1),
    changed as (select *, lag(rank) over (partition by entity order by grid_date) as before from dated),
    panel_rows as (
        select c.entity, c.grid_date, grade, rank, ship_day, datediff('day', ship_day, c.grid_date) as days_since, coalesce(rank >= 3, false) as investment_grade,
            case when rank < before then '{LABELS[0]}' when rank > before then '{LABELS[1]}' when rank = before then '{LABELS[2]}' end as direction,
            rank - before as change, c_mktsegment as sector
        from changed c left join customer on c.entity = c_custkey)"""


def status_panel(t):
    rated = jn.interval_join(history(t), "day", "valid_to", GRID)
    best = [F.desc_nulls_last("rank"), F.asc("agency"), F.desc("tie")]
    status = wn.first_per_key(rated, ["entity", "grid_date"], best).select("entity", "grid_date", "grade", "rank")
    events = shipments(t).select("entity", "ship_day")
    dated = jn.asof_join(status, events, ["entity"], "grid_date", "ship_day", [], GRID)
    w = wn.Window.partitionBy("entity").orderBy("grid_date")
    before = F.col("before")
    sector = t.customer.select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("sector"))
    return (
        dated.withColumn("before", F.lag("rank").over(w))
        .withColumns({
            "days_since": F.datediff("grid_date", "ship_day").cast("long"),
            "investment_grade": at_least(F.col("rank"), 3),
            "direction": wn.direction(F.col("rank"), before, LABELS),
            "change": F.col("rank") - before})
        .drop("before")
        .join(sector, "entity", "left"))


@query("panel_status", f"with {SQL_STATUS} select * from panel_rows")
def _(t):
    return status_panel(t)


@query("panel_status_report", f"""
    with {SQL_STATUS}
    select grid_date, count(*) as entities, count(*) filter (where direction = '{LABELS[0]}') as down, count(*) filter (where direction = '{LABELS[1]}') as up,
        count(*) filter (where direction = '{LABELS[2]}') as same, count(*) filter (where direction is null) as unknown, round(avg(days_since), 6) as mean_days
    from panel_rows group by grid_date""")
def _(t):
    d = F.col("direction")
    return status_panel(t).groupBy("grid_date").agg(
        F.count("*").alias("entities"), F.count_if(d == LABELS[0]).alias("down"), F.count_if(d == LABELS[1]).alias("up"),
        F.count_if(d == LABELS[2]).alias("same"), F.count_if(d.isNull()).alias("unknown"), F.round(F.avg("days_since"), 6).alias("mean_days"))


# The whole panel: status, sector and nation of the customer, its spending in the quarter, and the statement of
# the supplier with the same key, whose ratios and changes count.
_TABLES = ("sector", "nation", "spending", "statement")
SQL_FULL = f"""{SQL_STATUS}, {SQL_STATEMENTS}, {SQL_FAMILY}, {SQL_PANEL.replace("panel as", "spending as")},
    changes as (select a.ticker, a.period, a.Altman_Z, a.currentRatio, a.Altman_Z - b.Altman_Z as Altman_Z_diff, a.currentRatio - b.currentRatio as currentRatio_diff
        from family a left join family b on a.ticker = b.ticker and b.period = cast(a.period - interval 3 month as date)),
    fold as (
        select p.*, n_name as nation, s.n as orders, s.spend, Altman_Z, currentRatio, Altman_Z_diff, currentRatio_diff,
            c.c_custkey is not null as in_0, k.n_nationkey is not null as in_1, s.entity is not null as in_2, h.ticker is not null as in_3
        from panel_rows p left join customer c on p.entity = c.c_custkey left join nation k on c.c_nationkey = k.n_nationkey
        left join spending s on p.entity = s.entity and p.grid_date = s.period left join changes h on p.entity = h.ticker and p.grid_date = h.period)"""


def _full(t):
    customer = t.customer.select(F.col("c_custkey").alias("entity"), "c_nationkey")
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    spending = panel(t).select("entity", F.col("period").alias("grid_date"), F.col("n").alias("orders"), "spend")
    rows = stored(family(t), "family").withColumn("previous", F.add_months("period", -3))
    changes = jn.previous_period(rows, "ticker", "period", "previous", ["Altman_Z", "currentRatio"])
    changes = changes.select(F.col("ticker").alias("entity"), F.col("period").alias("grid_date"), "Altman_Z", "currentRatio", "Altman_Z_diff", "currentRatio_diff")
    steps = zip(_TABLES, (customer, nation, spending, changes), (["entity"], ["c_nationkey"], ["entity", "grid_date"], ["entity", "grid_date"]))
    return jn.audited_fold(status_panel(t), list(steps))


_ROUNDED = ("Altman_Z", "currentRatio", "Altman_Z_diff", "currentRatio_diff")


@query("panel_full", f"""
    with {SQL_FULL} select entity, grid_date, grade, rank, ship_day, days_since, investment_grade, direction, change, sector, nation, orders, spend,
        {", ".join(f"round({c}, 5) as {c}" for c in _ROUNDED)} from fold where in_0 and in_1 and in_2 and in_3""")
def _(t):
    full = _full(t)[0].drop("c_nationkey")
    return full.withColumns({c: F.round(c, 5) for c in _ROUNDED})


@query("panel_audit", f"""
    with {SQL_FULL}, n as (select count(*) as n0, count(*) filter (where in_0) as n1, count(*) filter (where in_0 and in_1) as n2,
        count(*) filter (where in_0 and in_1 and in_2) as n3, count(*) filter (where in_0 and in_1 and in_2 and in_3) as n4 from fold)
    select step::int as step, joined, rows_in, rows_out, rows_in - rows_out as lost, 0::bigint as repeated_keys from (
        {" union all ".join(f"select {i + 1} as step, '{x}' as joined, n{i} as rows_in, n{i + 1} as rows_out from n" for i, x in enumerate(_TABLES))})""")
def _(t):
    return _full(t)[1]


_DIFFED = ["Altman_Z", *fin.SCORE_RATIOS]


@query("panel_statement_changes", f"""
    with {SQL_STATEMENTS}, {SQL_SCORE_RATIOS}, {SQL_CLIPPED}, z as (select *, {SQL_Z} as Altman_Z from clipped)
    select a.ticker, a.period, round(a.Altman_Z, 5) as Altman_Z, {", ".join(f"round(a.{c} - b.{c}, 5) as {c}_diff" for c in _DIFFED)}
    from z a left join z b on a.ticker = b.ticker and b.period = cast(a.period - interval 3 month as date)""")
def _(t):
    """Winsorised score ratios, composite score and their change against the previous quarter."""
    clipped = fin.altman(fin.winsorise(score_ratios(t), fin.SCORE_LEVELS))
    rows = clipped.withColumn("previous", F.add_months("period", -3))
    out = jn.previous_period(rows, "ticker", "period", "previous", _DIFFED)
    return out.select("ticker", "period", F.round("Altman_Z", 5).alias("Altman_Z"), *[F.round(f"{c}_diff", 5).alias(f"{c}_diff") for c in _DIFFED])
