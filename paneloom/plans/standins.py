"""Test tables seen as the tables of the domain, in Spark and as SQL text.

ratings     orders: agency = status, entity = customer, grade = priority
shipments   line items through orders: the dated events of a customer
panel       one row per customer and order quarter
statements  sums of line items per supplier and ship quarter, as statement columns
lexicon     entries derived by rule from the words of the benchmark passages
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import MonthGrid
from ..functions.numbers import encode, ranks
from ..operators.text import tokens, words
from ..sources.readers import Tables

GRADES = ("URGENT", "HIGH", "MEDIUM", "LOW")  # best first; NOT SPECIFIED has no rank
GRADE_RANK = ranks(GRADES)
GRID = MonthGrid(date(1995, 1, 1), date(2001, 10, 1), 3)
END = date(2001, 12, 31)

SQL_RANK = (
    "case substr(o_orderpriority, 3) when 'URGENT' then 4 when 'HIGH' then 3 "
    "when 'MEDIUM' then 2 when 'LOW' then 1 end"
)
SQL_RATINGS = f"""ratings as (
    select o_orderstatus as agency, o_custkey as entity, cast(o_orderdate as date) as day,
           substr(o_orderpriority, 3) as grade, {SQL_RANK} as rank, o_orderkey as tie
    from orders)"""
SQL_GRID = """grid as (
    select cast(unnest(generate_series(date '1995-01-01', date '2001-10-01', interval 3 month)) as date) as grid_date)"""
SQL_SHIPMENTS = """shipments as (
    select o_custkey as entity, cast(l_shipdate as date) as ship_day, l_orderkey, l_linenumber,
           l_partkey, l_quantity, l_returnflag
    from lineitem join orders on l_orderkey = o_orderkey)"""
SQL_PANEL = f"""panel as (
    select o_custkey as entity, cast(date_trunc('quarter', o_orderdate) as date) as period,
           cast(date_trunc('quarter', o_orderdate) - interval 3 month as date) as previous,
           count(*) as n, round(sum(o_totalprice), 2) as spend, max({SQL_RANK}) as rank
    from orders group by 1, 2, 3)"""

# statement column -> (expression per line item)
STATEMENT = {
    "totalAssets": "l_extendedprice",
    "totalCurrentAssets": "case when l_returnflag <> 'R' then l_extendedprice else 0 end",
    "totalLiabilities": "case when l_linestatus = 'O' then l_extendedprice else 0 end",
    "totalCurrentLiabilities": "case when l_linestatus = 'O' and l_returnflag = 'R' then l_extendedprice else 0 end",
    "totalStockholdersEquity": "case when l_linestatus = 'F' then l_extendedprice else 0 end",
    "revenue": "l_extendedprice * (1 - l_discount)",
    "ebitda": "l_extendedprice * (l_tax + l_discount)",
    "depreciation": "l_extendedprice * l_tax",
    "netIncome_income_statement": "l_extendedprice * (l_tax - l_discount)",
    "retainedEarnings": "l_extendedprice * (l_discount - l_tax)",
    "inventory_balance_sheet": "case when l_quantity > 40 then l_extendedprice else 0 end",
    "cashAndCashEquivalents": "case when l_quantity < 5 then l_extendedprice else 0 end",
    "totalDebt": "case when l_returnflag = 'R' then l_extendedprice else 0 end",
    "operatingCashFlow": "l_extendedprice * (0.05 - l_discount)",
    "freeCashFlow": "l_extendedprice * (0.05 - l_discount) * l_tax",
    "weightedAverageShsOut": "l_quantity",
    "marketCap": "l_extendedprice * l_quantity",
}
SQL_STATEMENTS = (
    "statements as (select *, round(ebitda - depreciation, 6) as EBIT from (\n"
    "    select l_suppkey as ticker, cast(date_trunc('quarter', l_shipdate) as date) as period,\n        "
    + ",\n        ".join(f"round(sum({e}), 6) as {c}" for c, e in STATEMENT.items())
    + "\n    from lineitem group by 1, 2))"
)


def ratings(t: Tables) -> DataFrame:
    grade = F.substring("o_orderpriority", 3, 100)
    return t.orders.select(
        F.col("o_orderstatus").alias("agency"),
        F.col("o_custkey").alias("entity"),
        F.to_date("o_orderdate").alias("day"),
        grade.alias("grade"),
        encode(grade, GRADE_RANK).alias("rank"),
        F.col("o_orderkey").alias("tie"),
    )


def shipments(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("entity"))
    li = t.lineitem
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "entity", F.to_date("l_shipdate").alias("ship_day"), "l_orderkey", "l_linenumber",
        "l_partkey", "l_quantity", "l_returnflag",
    )


def panel(t: Tables) -> DataFrame:
    period = F.to_date(F.trunc(F.to_date("o_orderdate"), "quarter"))
    rows = t.orders.select(
        F.col("o_custkey").alias("entity"),
        period.alias("period"),
        "o_totalprice",
        encode(F.substring("o_orderpriority", 3, 100), GRADE_RANK).alias("rank"),
    )
    return (
        rows.groupBy("entity", "period")
        .agg(
            F.count("*").alias("n"),
            F.round(F.sum("o_totalprice"), 2).alias("spend"),
            F.max("rank").alias("rank"),
        )
        .withColumn("previous", F.add_months("period", -3))
        .select("entity", "period", "previous", "n", "spend", "rank")
    )


def statements(t: Tables) -> DataFrame:
    sums = [F.round(F.sum(F.expr(e)), 6).alias(c) for c, e in STATEMENT.items()]
    return (
        t.lineitem.groupBy(
            F.col("l_suppkey").alias("ticker"),
            F.trunc(F.to_date("l_shipdate"), "quarter").alias("period"),
        )
        .agg(*sums)
        .withColumn("EBIT", F.round(F.col("ebitda") - F.col("depreciation"), 6))
    )


# Words of the passages; every third length is split into two numbered senses, one of
# them without a frequency for even lengths. Marks follow from length and first letter.
SQL_TOKEN = r"$$[\p{L}\p{N}]+(?:[.'’_-][\p{L}\p{N}]+|,\p{N}+)*|[^\s\p{L}\p{N}]$$"
SQL_WORD = r"$$[\p{L}\p{N}]$$"


def sql_tokens(text: str = "text") -> str:
    return f"regexp_extract_all({text}, {SQL_TOKEN})"


def sql_words(text: str = "text") -> str:
    return f"[w for w in {sql_tokens(text)} if regexp_matches(w, {SQL_WORD})]"


_MARKS = {
    "Positiv": "length(w) % 2 = 0",
    "Negativ": "length(w) % 2 = 1",
    "Strong": "length(w) % 5 < 2",
    "Weak": "length(w) % 5 = 3",
    "Active": "ascii(w) % 2 = 0",
    "Passive": "ascii(w) % 2 = 1",
    "Ovrst": "length(w) > 8",
    "Undrst": "length(w) < 4",
}
_SENSES = (
    ("'#1'", "'| 60% noun'", "length(w) % 3 = 0"),
    ("'#2'", "case when length(w) % 2 = 0 then 'no share' else '| 40.5% verb' end", "length(w) % 3 = 0"),
    ("''", "'plain'", "length(w) % 3 <> 0"),
)


def _entry_select(word_source: str, flip: str) -> str:
    parts = []
    for i, (tag, defined, where) in enumerate(_SENSES):
        marks = ", ".join(
            f"case when {'not (' + m + ')' if i == 1 and c == flip else m} then '{c}' end as {c}"
            for c, m in _MARKS.items()
        )
        parts.append(f"select concat(w, {tag}) as Entry, {defined} as Defined, {marks} from {word_source} where {where}")
    return "\n    union all ".join(parts)


SQL_ENTRIES = (
    f"passage_words as (select distinct lower(unnest({sql_words()})) as w from benchmark),\n"
    "entries as (" + _entry_select("passage_words", "Positiv") + ")"
)
SQL_LEXICON = (
    SQL_ENTRIES
    + """,
senses as (
    select *, split_part(Entry, '#', 1) as root,
           row_number() over (partition by split_part(Entry, '#', 1)
               order by try_cast(trim(regexp_extract(Defined, '^[^|]*[|]([^|%]*)', 1)) as double) desc, Entry) as r
    from entries
    where contains(Entry, '#') and try_cast(trim(regexp_extract(Defined, '^[^|]*[|]([^|%]*)', 1)) as double) is not null),
marked as (
    select lower(Entry) as word, * exclude (Entry, Defined) from entries where not contains(Entry, '#')
    union all
    select lower(root), * exclude (Entry, Defined, root, r) from senses where r = 1),
lexicon as (
    select distinct word, unnest([c for c in
        [Positiv, Negativ, Strong, Weak, Active, Passive, Ovrst, Undrst] if c is not null]) as category
    from marked)"""
)


def entries(t: Tables) -> DataFrame:
    found = t.benchmark.select(F.explode(words(tokens(F.col("text")))).alias("w"))
    vocabulary = found.select(F.lower("w").alias("w")).distinct()
    out = None
    for i, (tag, defined, where) in enumerate(_SENSES):
        marks = [
            F.when(F.expr(f"not ({m})" if i == 1 and c == "Positiv" else m), F.lit(c)).alias(c)
            for c, m in _MARKS.items()
        ]
        part = vocabulary.where(where).select(
            F.concat("w", F.expr(tag)).alias("Entry"), F.expr(defined).alias("Defined"), *marks
        )
        out = part if out is None else out.unionByName(part)
    return out


# Names of firms: the first, second and third three words of each document, a few hundred words in all.
SQL_FIRMS = r"""firms as (
    select doc_id, k, array_to_string(ws[3 * k + 1:3 * k + 3], ' ') as name
    from (select doc_id, unnest(range(3)) as k, regexp_extract_all(replace(text, 'ß', 'ss'), '[^ \t\n\r\f\v]+') as ws from documents)
    where len(ws) >= 3 * k + 3)"""


def firms(t: Tables) -> DataFrame:
    """doc_id, k, name."""
    head = F.regexp_extract("text", r"^(?:[ \t\n\r\f\x0B]*+[^ \t\n\r\f\x0B]++){0,9}", 0)  # names need no more than nine words
    found = F.regexp_extract_all(F.replace(head, F.lit("ß"), F.lit("ss")), F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))
    rows = t.documents.select("doc_id", found.alias("ws")).select("doc_id", "ws", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    rows = rows.where(F.size("ws") >= 3 * F.col("k") + 3)
    return rows.select("doc_id", "k", F.array_join(F.slice("ws", 3 * F.col("k") + 1, 3), " ").alias("name"))


def sql_best_match(left: str, right: str, a: str, b: str, threshold: float, not_equal: bool = False) -> str:
    """Best partner by trigrams, of the tables ``left`` (name) and ``right`` (name), through their common grams."""
    grams = "list_distinct([substr(name, i, 3) for i in range(1, greatest(length(name) - 2, 1) + 1)])"
    return f"""x as (select distinct name, {grams} as g from {left}), y as (select distinct name, {grams} as g from {right}),
    xg as (select name, len(g) as size, unnest(g) as gram from x), yg as (select name, len(g) as size, unnest(g) as gram from y),
    c as (select xg.name as {a}, yg.name as {b}, count(*) / (any_value(xg.size) + any_value(yg.size) - count(*)) as similarity
        from xg join yg using (gram) {"where xg.name <> yg.name" if not_equal else ""} group by xg.name, yg.name having similarity >= {threshold})
    select {a}, {b}, round(similarity, 6) as similarity from (
        select *, row_number() over (partition by {a} order by similarity desc, {b}) as r from c) where r = 1"""
