"""Ordered operators per entity.

A history may have one entity with a third of all rows, so ``neighbours`` (and all
that is built on it) never sorts a whole entity in one task: rows are ordered inside
(entity, time span) groups, and the last and first row of every span, found by a
map-side combined aggregate, are carried over to the adjoining spans.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import days
from ..session import stored


def even_spans(df: DataFrame, key: Sequence[str], order: Sequence[str], out: str = "_span") -> DataFrame:
    """Number the range partitions of (key, order): spans of about equal size, in order (written once)."""
    return stored(df.repartitionByRange(*key, *order).withColumn(out, F.spark_partition_id()), "spans")


def neighbours(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    previous: Sequence[str] = (),
    following: Sequence[str] = (),
    span: str | Column | None = None,
    flag: str | None = None,
) -> DataFrame:
    """Add ``previous_<c>`` and ``next_<c>``: the value in the row before/after.

    With ``flag``, a column of that name says whether there is a row before (``previous``
    is then needed); a null previous value alone does not tell.

    ``order`` must be total within ``key``; key columns and ``order[0]`` are not null.
    Rows are ordered within spans of a key, and each span passes its edge rows on to the
    adjoining ones. By default spans are range partitions over (key, order), so a key with
    a third of all rows is cut into as many spans as it needs (one more shuffle and a
    written table). ``span`` names another cut: the unit that ``order[0]`` (a date) is cut by, or any
    expression that never decreases along ``order``; the rows are then shuffled once.
    """
    if span is None:
        df = even_spans(df, key, order)
    else:
        df = df.withColumn("_span", F.trunc(order[0], span) if isinstance(span, str) else span)
    at = F.struct(*order)
    wanted = {}
    if previous:
        wanted["_tail"] = F.max_by(F.struct(*previous), at)
    if following:
        wanted["_head"] = F.min_by(F.struct(*following), at)
    spans = df.groupBy(*key, "_span").agg(*[v.alias(k) for k, v in wanted.items()])
    across = Window.partitionBy(*key).orderBy("_span")
    carried = [F.col(k) for k in [*key, "_span"]]
    if previous:
        carried.append(F.lag("_tail").over(across).alias("_before"))
    if following:
        carried.append(F.lead("_head").over(across).alias("_after"))
    edges = spans.select(*carried)

    inside = Window.partitionBy(*key, "_span").orderBy(*order)
    out = df.join(edges, [*key, "_span"], "left")
    new = {}
    if previous:
        before = F.coalesce(F.lag(F.struct(*previous)).over(inside), F.col("_before"))
        out = out.withColumn("_p", before)
        new.update({f"previous_{c}": F.col("_p")[c] for c in previous})
        if flag:
            new[flag] = F.col("_p").isNotNull()
    if following:
        after = F.coalesce(F.lead(F.struct(*following)).over(inside), F.col("_after"))
        out = out.withColumn("_n", after)
        new.update({f"next_{c}": F.col("_n")[c] for c in following})
    return out.withColumns(new).drop("_span", "_before", "_after", "_p", "_n")


def validity(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    end: date,
    valid_to: str = "valid_to",
    span: str | Column | None = None,
) -> DataFrame:
    """Close each row's interval at the next row's date, the last one at ``end``."""
    when = order[0]
    out = neighbours(df, key, order, following=[when], span=span)
    return out.withColumn(valid_to, F.coalesce(f"next_{when}", F.lit(end))).drop(f"next_{when}")


def event_type(grade: str = "grade", rank: str = "rank", first: Column | None = None) -> Column:
    """Kind of a row against its predecessor's ``previous_<grade>`` and ``previous_<rank>``.

    ``first`` says that there is no predecessor; by default a null previous grade.
    """
    before = F.col(f"previous_{rank}")
    first = F.col(f"previous_{grade}").isNull() if first is None else first
    return (
        F.when(first, "Ambiguous")
        .when(F.col(grade).eqNullSafe(F.col(f"previous_{grade}")), "Affirmation")
        .when(F.col(rank) > before, "Upgrade")
        .when(F.col(rank) < before, "Downgrade")
        .otherwise("Change")
    )


def signed_step(kind: Column, rank: str = "rank") -> Column:
    """0 for affirmations, rank change for up- and downgrades, else null."""
    moved = F.col(rank) - F.col(f"previous_{rank}")
    return F.when(kind == "Affirmation", F.lit(0)).when(kind.isin("Upgrade", "Downgrade"), moved)


def direction(now: Column, before: Column, labels: tuple[str, str, str]) -> Column:
    """Label (lower, higher, same) of a change of code; null if a code is unknown."""
    return F.when(now < before, labels[0]).when(now > before, labels[1]).when(now == before, labels[2])


def fill_forward(df: DataFrame, key: str, time: str, value: str, start: date, stop: date, tie: Sequence[str]) -> DataFrame:
    """Daily series: last known value on each day of [start, stop], none before the first.

    Several values on one day are first reduced to the last of them, so that a key has
    at most one row per day; each value is then spread over the days until the next.
    """
    day = F.to_date(time)
    daily = (
        df.where(F.col(value).isNotNull() & day.between(F.lit(start), F.lit(stop)))
        .groupBy(key, day.alias("day"))
        .agg(F.max_by(value, F.struct(time, *tie)).alias(value))
    )
    w = Window.partitionBy(key).orderBy("day")
    until = F.coalesce(F.date_sub(F.lead("day").over(w), 1), F.lit(stop))
    return daily.withColumn("_until", until).select(
        key, F.explode(days(F.col("day"), F.col("_until"))).alias("day"), value
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key in a total order.

    The rank filter is pushed below the shuffle (window group limit): each map task
    sends at most one row per key.
    """
    return top_per_group(df, keys, order, 1, rank=None)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank: str | None = "rank") -> DataFrame:
    """First ``k`` rows per group in a total order, with their rank unless ``rank`` is None."""
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def group_stat(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Attach group aggregates to the rows: map-side combined aggregate, then a join.

    Unlike a window over the group this never brings a group into one task.
    """
    side = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(side, list(keys))


def with_class_value(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Attach ``value`` of a table with a row per class.

    The table is written first, so Spark broadcasts it if it is measured to be small, and a huge class
    does not go to one task; beyond that the join's skew handling splits the class.
    """
    return df.join(stored(table.select(key, value), "classes"), key, "left").select(*df.columns, value)


def attrition(df: DataFrame, key: str, period: str) -> DataFrame:
    """Entities whose last period lies before the last period of the table."""
    last = df.groupBy(key).agg(F.max(period).alias("last_period"))
    return last.where(F.col("last_period") < df.agg(F.max(period)).scalar())


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Descending rank, ties share their average, cut to an integer.

    Ranks are computed over distinct values and their counts, not over rows: running
    counts inside even spans of (by, value), plus the totals of the higher spans.
    """
    counts = even_spans(df.groupBy(*by, value).agg(F.count("*").alias("_n")), by, [value])
    higher = Window.partitionBy(*by).orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*by, "_span").agg(F.sum("_n").alias("_s")).withColumn(
        "_higher", F.coalesce(F.sum("_s").over(higher), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*by, "_span").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum("_n").over(inside), F.lit(0)) + F.col("_higher")
    ranks = counts.join(totals, [*by, "_span"]).withColumn(out, F.floor(above + 1 + (F.col("_n") - 1) / 2))
    return df.join(ranks.drop("_n", "_span", "_higher"), [*by, value])
