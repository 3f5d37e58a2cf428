"""Scalar functions, sorts, array helpers and statement cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import dates as D
from ..functions import numbers as N
from ..functions import strings as S
from ..operators import aggregates as ag
from ..operators import finance as fin
from ..operators import text as tx
from ..operators.joins import previous_period
from ..session import stored
from .base import query
from .standins import GRADE_RANK, GRADES, GRID, SQL_GRID, SQL_PANEL, SQL_STATEMENTS, panel, statements


# ---------------------------------------------------------------- strings


@query("fn_s1_strip", """
    select p_partkey, trim(trim(concat('+', p_name, '-'), '+'), '-') as stripped, trim(concat('  ', p_brand, ' ')) as trimmed from part""")
def _(t):
    return t.part.select(
        "p_partkey",
        S.strip_chars(F.concat(F.lit("+"), "p_name", F.lit("-")), "+", "-").alias("stripped"),
        F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"))


@query("fn_s2_literal_replace", """
    select p_partkey, cast(replace(p_brand, 'Brand#', '') as integer) as brand from part""")
def _(t):
    return t.part.select("p_partkey", F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("brand"))


def _sql_replace(expr: str, rules) -> str:
    for a, b in rules:
        expr = f"replace({expr}, '{a}', '{b}')"
    return expr


_FIRM = "concat(upper(p_name), case p_size % 5 when 0 then ' CORP.' when 1 then ' HOLDINGS INC.' when 2 then ' NETWORKS & CO.' when 3 then ' CO LTD' else ' PARTNERS LP' end)"


def _firms(t):
    tail = F.lit(" PARTNERS LP")
    for i, s in enumerate((" CORP.", " HOLDINGS INC.", " NETWORKS & CO.", " CO LTD")):
        tail = F.when(F.col("p_size") % 5 == i, s).otherwise(tail)
    return t.part.select("p_partkey", F.concat(F.upper("p_name"), tail).alias("firm"))


@query("fn_s3_rule_chain", f"select p_partkey, {_sql_replace(_FIRM, tx.NAME_RULES)} as name from part")
def _(t):
    return _firms(t).select("p_partkey", S.replace_chain(F.col("firm"), tx.NAME_RULES).alias("name"))


@query("fn_s4_regex_removals", rf"""
    select p_partkey, regexp_replace(regexp_replace(regexp_replace({_FIRM}, 'CORP\.$', ''), ' LTD$', ''), '[^\w\s]$', '') as name from part""")
def _(t):
    clean = S.remove_patterns(F.col("firm"), [r"CORP\.$", " LTD$", r"[^\w\s]$"])
    return _firms(t).select("p_partkey", clean.alias("name"))


@query("fn_s4_collapse_newlines", r"""
    select doc_id, length(regexp_replace(text, '\n+', chr(10), 'g')) as n from documents""")
def _(t):
    return t.documents.select("doc_id", F.length(S.collapse_newlines(F.col("text"))).cast("long").alias("n"))


@query("fn_s5_override", """
    select c_custkey, case c_mktsegment when 'HOUSEHOLD' then 'HOME' when 'MACHINERY' then 'INDUSTRY' else lower(c_mktsegment) end as segment from customer""")
def _(t):
    seg = F.col("c_mktsegment")
    return t.customer.select("c_custkey", S.override(F.lower(seg), seg, {"HOUSEHOLD": "HOME", "MACHINERY": "INDUSTRY"}).alias("segment"))


@query("fn_s6_case", "select s_suppkey, upper(s_name) as up, lower(s_name) as low from supplier")
def _(t):
    return t.supplier.select("s_suppkey", F.upper("s_name").alias("up"), F.lower("s_name").alias("low"))


@query("fn_s7_cut_from_keyword", """
    select doc_id, md5(case when strpos(lower(text), 'the') > 0 then substr(text, strpos(lower(text), 'the')) else text end) as digest from documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(S.cut_from(F.col("text"), "The")).alias("digest"))


@query("fn_s8_slices", """
    select o_orderkey, substr(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 1, 10) as day,
        cast(substr(concat(year(o_orderdate), quarter(o_orderdate)), 1, 4) as integer) as year,
        cast(substr(concat(year(o_orderdate), quarter(o_orderdate)), 5, 1) as integer) as quarter from orders""")
def _(t):
    code = F.concat(F.year("o_orderdate"), F.quarter("o_orderdate"))
    return t.orders.select(
        "o_orderkey",
        F.substring(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), 1, 10).alias("day"),
        F.substring(code, 1, 4).cast("int").alias("year"), F.substring(code, 5, 1).cast("int").alias("quarter"))


@query("fn_s9_length", "select page_id, length(html) as n from pages")
def _(t):
    return t.pages.select("page_id", F.length("html").cast("long").alias("n"))


@query("fn_s10_count_occurrences", """
    select doc_id, cast((length(lower(text)) - length(replace(lower(text), 'th', ''))) / 2 as bigint) as n_th,
        cast(length(text) - length(replace(text, '.', '')) as bigint) as n_stops from documents""")
def _(t):
    x = F.col("text")
    return t.documents.select("doc_id", S.count_occurrences(x, "Th").alias("n_th"), S.count_occurrences(x, ".", False).alias("n_stops"))


@query("fn_s11_split_first", r"""
    select page_id, split_part(url, '://', 1) as scheme, substr(url, strpos(url, '://') + 3) as rest from pages""")
def _(t):
    parts = S.split_first(F.col("url"), "://")
    return t.pages.select("page_id", parts[0].alias("scheme"), parts[1].alias("rest"))


@query("fn_s12_recode", """
    select o_orderkey, case when contains(o_orderpriority, 'URGENT') then 'Upgrade' when contains(o_orderpriority, 'LOW') then 'Downgrade'
        when contains(o_orderpriority, 'SPEC') then 'Same' else o_orderpriority end as label from orders""")
def _(t):
    codes = {"URGENT": "Upgrade", "LOW": "Downgrade", "SPEC": "Same"}
    return t.orders.select("o_orderkey", S.recode_by_substring(F.col("o_orderpriority"), codes).alias("label"))


@query("fn_s13_formats", """
    select o_orderstatus, format('{:,}', cast(count(*) as bigint)) as n,
        concat(printf('%.2f', 100.0 * count(*) / (select count(*) from orders)), '%') as share from orders group by o_orderstatus""")
def _(t):
    counts = ag.value_counts(t.orders, "o_orderstatus")
    return counts.select("o_orderstatus", S.thousands(F.col("n")).alias("n"), S.percent(F.col("share")).alias("share"))


@query("fn_s14_number_in_text", """
    with x as (select p_partkey, concat('sense | ', case when p_size % 4 = 0 then 'none' else cast(p_size as varchar) end, '% noun') as d from part)
    select p_partkey, try_cast(trim(regexp_extract(d, '^[^|]*[|]([^|%]*)', 1)) as double) as freq from x""")
def _(t):
    size = F.when(F.col("p_size") % 4 == 0, "none").otherwise(F.col("p_size").cast("string"))
    text = F.concat(F.lit("sense | "), size, F.lit("% noun"))
    return t.part.select("p_partkey", S.number_between(text, "|", "%").alias("freq"))


# ---------------------------------------------------------------- dates


@query("fn_d1_parse_dates", """
    select event_id, cast(ts as date) as day, cast(strftime(ts, '%Y-%m-%d') as date) as parsed from events""")
def _(t):
    text = F.date_format("ts", "yyyy-MM-dd")
    return t.events.select("event_id", F.to_date("ts").alias("day"), F.to_date(text, "yyyy-MM-dd").alias("parsed"))


@query("fn_d2_parts", "select o_orderkey, year(o_orderdate) as y, quarter(o_orderdate) as q, month(o_orderdate) as m from orders")
def _(t):
    d = "o_orderdate"
    return t.orders.select("o_orderkey", *[c.cast("long").alias(n) for n, c in (("y", F.year(d)), ("q", F.quarter(d)), ("m", F.month(d)))])


@query("fn_d3_month_arithmetic", f"with {SQL_PANEL} select entity, period, previous from panel")
def _(t):
    return panel(t).select("entity", "period", F.add_months("period", -3).alias("previous"))


@query("fn_d4_day_difference", """
    select l_orderkey, l_linenumber, l_partkey, datediff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as lag
    from lineitem join orders on l_orderkey = o_orderkey""")
def _(t):
    li, o = t.lineitem, t.orders
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("lag"))


@query("fn_d5_period_deviation", """
    with x as (select event_id, cast(ts as date) as day, 2023 + cast(user_id % 2 as integer) as y, 1 + cast(event_id % 4 as integer) as q from events),
    d as (select event_id, datediff('day', make_date(y, (q - 1) * 3 + 1, 1), day) as deviation from x)
    select * from d where deviation > -250 and deviation < 250""")
def _(t):
    e = t.events.select(
        "event_id", F.to_date("ts").alias("day"),
        (2023 + F.col("user_id") % 2).cast("int").alias("y"), (1 + F.col("event_id") % 4).cast("int").alias("q"))
    near = D.within_deviation(F.col("day"), F.col("y"), F.col("q"))
    return e.where(near).select("event_id", D.period_deviation(F.col("day"), F.col("y"), F.col("q")).cast("long").alias("deviation"))


@query("fn_d6_grids", f"""
    with {SQL_GRID}, span as (select cast(min(ts) as date) as a, cast(max(ts) as date) as b from events)
    select 'quarter' as grid, grid_date as day from grid
    union all select 'day', cast(unnest(generate_series(a, b, interval 1 day)) as date) from span""")
def _(t):
    span = t.events.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    daily = span.select(F.lit("day").alias("grid"), F.explode(D.days(F.col("a"), F.col("b"))).alias("day"))
    return span.select(F.lit("quarter").alias("grid"), F.explode(GRID.points()).alias("day")).union(daily)


# ---------------------------------------------------------------- numbers


@query("fn_m1_ordinal_codes", f"""
    with c as (select o_orderkey, substr(o_orderpriority, 3) as grade,
        case substr(o_orderpriority, 3) when 'URGENT' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 end as code from orders)
    select o_orderkey, code, case when code is not null then grade end as decoded from c""")
def _(t):
    code = N.encode(F.substring("o_orderpriority", 3, 100), GRADE_RANK)
    coded = t.orders.select("o_orderkey", code.alias("code"))
    return coded.withColumn("decoded", N.decode(F.col("code"), GRADE_RANK))


def _sql_ratio(num: str, den: str) -> str:
    return f"({num}) / nullif({den}, 0)"


_ALL_RATIOS = {**fin.SCORE_RATIOS, **fin.RATIOS}
_LONG_RATIOS = ", ".join(f"{_sql_ratio(n, d)} as {name}" for name, (n, d) in _ALL_RATIOS.items())


@query("fn_m2_ratios", f"with {SQL_STATEMENTS} select ticker, period, {_LONG_RATIOS} from statements")
def _(t):
    cols = fin.ratio_columns(_ALL_RATIOS)
    return statements(t).select("ticker", "period", *[c.alias(n) for n, c in cols.items()])


SQL_SCORE_RATIOS = (
    "score_ratios as (select *, "
    + ", ".join(f"{_sql_ratio(n, d)} as {name}" for name, (n, d) in fin.SCORE_RATIOS.items())
    + " from statements)"
)
SQL_Z = " + ".join(f"{w} * {n}" for n, w in fin.SCORE_WEIGHTS.items())
SQL_CLIPPED = (
    "bounds as (select "
    + ", ".join(f"quantile_cont({n}, {lo}) as {n}_lo, quantile_cont({n}, {hi}) as {n}_hi" for n, (lo, hi) in fin.SCORE_LEVELS.items())
    + " from score_ratios), clipped as (select ticker, period, "
    + ", ".join(f"case when {n} is not null then greatest(least({n}, {n}_hi), {n}_lo) end as {n}" for n in fin.SCORE_LEVELS)
    + " from score_ratios, bounds)"
)


def score_ratios(t):
    """Statements with their score ratios; written, as the quantiles and the rows both read them."""
    return stored(statements(t).withColumns(fin.ratio_columns(fin.SCORE_RATIOS)), "score_ratios")


@query("fn_m3_linear_score", f"""
    with {SQL_STATEMENTS}, {SQL_SCORE_RATIOS}, {SQL_CLIPPED}
    select s.ticker, s.period, round(s.z, 5) as z_before, round(c.z, 5) as z_after
    from (select ticker, period, {SQL_Z} as z from score_ratios) s
    join (select ticker, period, {SQL_Z} as z from clipped) c on s.ticker = c.ticker and s.period = c.period""")
def _(t):
    before = fin.altman(score_ratios(t), "z_before")
    after = fin.altman(fin.winsorise(before, fin.SCORE_LEVELS), "z_after")
    return after.select("ticker", "period", F.round("z_before", 5).alias("z_before"), F.round("z_after", 5).alias("z_after"))


@query("fn_m4_identity_checks", f"""
    with {SQL_STATEMENTS}
    select ticker, period, case when "totalLiabilities" > "totalCurrentLiabilities" then "totalLiabilities" end as tl,
        case when "totalLiabilities" > "totalCurrentLiabilities" then "totalCurrentLiabilities" end as tcl,
        case when "totalAssets" > "totalCurrentAssets" then "totalAssets" end as ta,
        case when "totalAssets" > "totalCurrentAssets" then "totalCurrentAssets" end as tca,
        case when revenue > EBIT then revenue end as rev, case when revenue > EBIT then EBIT end as ebit_checked from statements""")
def _(t):
    c = fin.identity_checks(statements(t))
    return c.select(
        "ticker", "period", F.col("totalLiabilities").alias("tl"), F.col("totalCurrentLiabilities").alias("tcl"),
        F.col("totalAssets").alias("ta"), F.col("totalCurrentAssets").alias("tca"),
        F.col("revenue").alias("rev"), F.col("EBIT").alias("ebit_checked"))


@query("fn_m5_unit_fix", """
    with x as (select o_orderkey, case when o_orderkey % 50 = 0 then floor(o_totalprice) * 1000 else o_totalprice end as price from orders),
    b as (select quantile_cont(price, 0.025) as lo, quantile_cont(price, 0.975) as hi from x)
    select o_orderkey, case when price % 1000 = 0 and price <> 0 and abs(price) < 1e16 and (price < lo or price > hi) then price / 1000 else price end as price
    from x, b""")
def _(t):
    big = F.floor("o_totalprice").cast("double") * 1000
    x = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, big).otherwise(F.col("o_totalprice")).alias("price"))
    return fin.unit_fix(x, ["price"])


@query("fn_m6_winsorise", f"""
    with {SQL_STATEMENTS}, {SQL_SCORE_RATIOS}, {SQL_CLIPPED}
    select ticker, period, {", ".join(f"round({n}, 6) as {n}" for n in fin.SCORE_LEVELS)} from clipped""")
def _(t):
    c = fin.winsorise(score_ratios(t), fin.SCORE_LEVELS)
    return c.select("ticker", "period", *[F.round(n, 6).alias(n) for n in fin.SCORE_LEVELS])


# The later ratios keep a signed infinity on a zero denominator until they are clipped.
_SQL_SIGNED = ", ".join(
    f"case when ({d}) = 0 then case when ({n}) > 0 then 'inf'::double when ({n}) < 0 then '-inf'::double end else ({n}) / ({d}) end as {name}"
    for name, (n, d) in fin.RATIOS.items())


def _sql_quantile(values: str, p: float) -> str:
    """Of a sorted list: between its neighbours, or the value itself where they are equal (also infinities)."""
    at = f"floor((len({values}) - 1) * {p})::bigint"
    low, high, part = f"{values}[{at} + 1]", f"{values}[least({at} + 2, len({values}))]", f"((len({values}) - 1) * {p} - {at})"
    return f"case when {low} = {high} or {part} = 0 then {low} else (1 - {part}) * {low} + {part} * {high} end"


@query("fn_m6_clipped_ratios", f"""
    with {SQL_STATEMENTS}, signed as (select ticker, period, {_SQL_SIGNED} from statements),
    lists as (select {", ".join(f"list({n} order by {n}) filter (where {n} is not null) as {n}_l" for n in fin.RATIOS)} from signed),
    bounds as (select {", ".join(f"{_sql_quantile(f'{n}_l', 0.025)} as {n}_lo, {_sql_quantile(f'{n}_l', 0.975)} as {n}_hi" for n in fin.RATIOS)} from lists)
    select ticker, period, {", ".join(f"round(case when {n} is not null then greatest(least({n}, {n}_hi), {n}_lo) end, 6) as {n}" for n in fin.RATIOS)} from signed, bounds""")
def _(t):
    rows = stored(statements(t).withColumns(fin.ratio_columns(fin.RATIOS, zero_division="clip")), "signed")
    clipped = fin.winsorise(rows, {n: (0.025, 0.975) for n in fin.RATIOS})
    return clipped.select("ticker", "period", *[F.round(n, 6).alias(n) for n in fin.RATIOS])


@query("fn_m7_smoothed_log_ratio", """
    select l_suppkey, round(log10((count(*) filter (where l_returnflag = 'A') + 1.0) / (count(*) filter (where l_returnflag = 'R') + 1.0)), 6) as score
    from lineitem group by l_suppkey""")
def _(t):
    g = t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return g.select("l_suppkey", F.round(N.smoothed_log_ratio(F.col("a"), F.col("r")), 6).alias("score"))


@query("fn_m8_differences", f"""
    with {SQL_STATEMENTS}
    select ticker, period, round("totalAssets" - "totalDebt", 6) as net_assets, round(revenue - EBIT, 6) as cost,
        round("operatingCashFlow" - "freeCashFlow", 6) as capex from statements""")
def _(t):
    d = fin.differences({"net_assets": ("totalAssets", "totalDebt"), "cost": ("revenue", "EBIT"), "capex": ("operatingCashFlow", "freeCashFlow")})
    return statements(t).select("ticker", "period", *[F.round(c, 6).alias(n) for n, c in d.items()])


# Ratios that come with the statements, here from their columns.
_GIVEN = {
    "grossProfitRatio": ("revenue - inventory_balance_sheet", "revenue"),
    "ebitdaratio": ("ebitda", "revenue"),
    "operatingIncomeRatio": ("EBIT", "revenue"),
    "incomeBeforeTaxRatio": ("EBIT - 0.01 * totalDebt", "revenue"),
    "netIncomeRatio": ("netIncome_income_statement", "revenue"),
}
_FAMILY = {**fin.SCORE_RATIOS, **_GIVEN, **fin.RATIOS}
SQL_FAMILY = f"""family as (select *, {SQL_Z} as Altman_Z from (
    select ticker, period, {", ".join(f"{_sql_ratio(n, d)} as {name}" for name, (n, d) in _FAMILY.items())} from statements))"""


def family(t):
    """All variables whose change is kept, of every statement."""
    rows = statements(t).withColumns(fin.ratio_columns(_FAMILY))
    return fin.altman(rows).select("ticker", "period", *fin.DIFFERENCED)


@query("fn_m8_change_family", f"""
    with {SQL_STATEMENTS}, {SQL_FAMILY}
    select a.ticker, a.period, {", ".join(f"round(a.{c} - b.{c}, 5) as {c}_diff" for c in fin.DIFFERENCED)}
    from family a left join family b on a.ticker = b.ticker and b.period = cast(a.period - interval 3 month as date)""")
def _(t):
    rows = stored(family(t), "family").withColumn("previous", F.add_months("period", -3))
    out = previous_period(rows, "ticker", "period", "previous", fin.DIFFERENCED)
    return out.select("ticker", "period", *[F.round(f"{c}_diff", 5).alias(f"{c}_diff") for c in fin.DIFFERENCED])


@query("fn_m9_threshold_flag", f"""
    with {SQL_PANEL} select entity, period, coalesce(rank >= 3, false) as investment_grade from panel""")
def _(t):
    return panel(t).select("entity", "period", N.at_least(F.col("rank"), 3).alias("investment_grade"))


@query("fn_m10_standardise", """
    select c_custkey, round((c_acctbal - m) / s, 6) as balance from customer, (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as s from customer)""")
def _(t):
    z = fin.standardise(t.customer.select("c_custkey", F.col("c_acctbal").alias("balance")), ["balance"])
    return z.select("c_custkey", F.round("balance", 6).alias("balance"))


@query("fn_m11_cosine", """
    with m as (select list(v order by i) as c from (
        select i, avg(cast(embedding[i] as double)) as v from embeddings, range(1, 65) r(i) group by i))
    select vec_id, round(list_cosine_similarity(cast(embedding as double[]), c), 6) as similarity from embeddings, m""")
def _(t):
    centre = ag.vector_mean(t.embeddings, [], "embedding", 64).scalar()
    return t.embeddings.withColumn("_c", centre).select(
        "vec_id", F.round(N.cosine(F.col("embedding"), F.col("_c")), 6).alias("similarity"))


@query("fn_m12_ordinal_distance", """
    select o_orderkey, abs(cast(substr(o_orderpriority, 1, 1) as integer) - 1 - o_custkey % 5) as gap,
        abs(cast(substr(o_orderpriority, 1, 1) as integer) - 1 - o_custkey % 5) <= 1 as near from orders""")
def _(t):
    gap = N.ordinal_distance(F.substring("o_orderpriority", 1, 1).cast("int") - 1, F.col("o_custkey") % 5)
    return t.orders.select("o_orderkey", gap.alias("gap"), (gap <= 1).alias("near"))


# ---------------------------------------------------------------- arrays


@query("fn_a1_canonical_pair", """
    select l_orderkey, l_linenumber, least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem""")
def _(t):
    lo, hi = A.pair(F.col("l_partkey"), F.col("l_suppkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", lo.alias("a"), hi.alias("b"))


@query("fn_a2_explode", """
    select doc_id, lang, part from (select doc_id, lang, unnest(string_split(source, 'c')) as part from documents)""")
def _(t):
    return t.documents.select("doc_id", "lang", F.explode(F.split("source", "c")).alias("part"))


@query("fn_a3_filter_array", """
    with x as (select doc_id, string_split(lower(text), ' ') as w from documents)
    select doc_id, len([y for y in w if regexp_full_match(y, '[a-z]+') and y not in ('the', 'of', 'and')]) as kept, len(w) as n from x""")
def _(t):
    words = F.split(F.lower("text"), " ")
    keep = F.filter(words, lambda w: w.rlike("^[a-z]+$") & ~w.rlike("\\n") & ~w.isin("the", "of", "and"))
    return t.documents.select("doc_id", F.size(keep).cast("long").alias("kept"), F.size(words).cast("long").alias("n"))


@query("fn_a4_widen_vector", "select vec_id, " + ", ".join(
    f"round(cast(embedding[{i + 1}] as double), 6) as v{i}" for i in range(64)) + " from embeddings")
def _(t):
    doubles = F.transform("embedding", lambda x: F.round(x.cast("double"), 6))
    return t.embeddings.select("vec_id", *A.widen(doubles, 64, "v"))


@query("fn_a5_wrapped_list", r"""
    with w as (select item_id, string_split(text, ' ') as w from benchmark)
    select item_id, case when len(w) > 2 then concat(array_to_string(w[1:2], ', '), ',' || chr(10), array_to_string(w[3:], ', '))
        else array_to_string(w, ', ') end as listed from w""")
def _(t):
    return t.benchmark.select("item_id", A.wrapped_list(F.split("text", " ")).alias("listed"))


# ---------------------------------------------------------------- sorts and limits


@query("st1_mixed_sort", """
    select o_custkey, cast(o_orderdate as date) as day, o_orderkey from orders
    order by o_custkey asc, o_orderdate desc, o_orderkey asc""")
def _(t):
    return t.orders.orderBy(F.asc("o_custkey"), F.desc("o_orderdate"), F.asc("o_orderkey")).select(
        "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey")


@query("st2_extremes_per_entity", """
    select o_custkey, max(o_totalprice) as o_totalprice from orders group by 1 order by 2 desc, 1 limit 20""")
def _(t):
    return ag.extremes_per_entity(t.orders, "o_custkey", "o_totalprice", 20)


@query("st3_ordinal_order", """
    select substr(o_orderpriority, 3) as grade, count(*) as n, case substr(o_orderpriority, 3)
        when 'URGENT' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 end as code
    from orders group by 1, 3 order by code desc nulls last""")
def _(t):
    counts = t.orders.groupBy(F.substring("o_orderpriority", 3, 100).alias("grade")).agg(F.count("*").alias("n"))
    return counts.withColumn("code", N.encode(F.col("grade"), GRADE_RANK)).orderBy(F.desc_nulls_last("code"))


@query("st4_top_terms", """
    select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents)
    group by word order by n desc, word limit 25""")
def _(t):
    found = t.documents.select("text").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return ag.top_values(found, "word", 25)


@query("st5_top_importance", """
    select p_brand as feature, concat(p_brand, ' ', 'line') as display, round(avg(p_retailprice), 4) as importance
    from part group by p_brand order by avg(p_retailprice) desc, p_brand limit 15""")
def _(t):
    imp = t.part.groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("importance"))
    names = t.part.select(F.col("p_brand").alias("feature"), F.concat_ws(" ", "p_brand", F.lit("line")).alias("display")).distinct()
    top = imp.join(names, "feature").orderBy(F.desc("importance"), "feature").limit(15)
    return top.select("feature", "display", F.round("importance", 4).alias("importance"))
