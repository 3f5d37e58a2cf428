"""Row selection with an audit of what was lost."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.strings import matches


def first_missing(cols: Sequence[str]) -> Column:
    """Position (1-based) of the first null column of a row, null for a complete row."""
    return F.coalesce(*[F.when(F.col(c).isNull(), i) for i, c in enumerate(cols, 1)])


def complete_cases(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without a null in ``required``, and the rows lost at each column in order.

    Dropping column after column loses a row at its first null column, so one pass
    gives the same counts.
    """
    marked = df.withColumn("_first", first_missing(required))
    names = F.array(*[F.lit(c) for c in required])
    audit = (
        marked.where("_first is not null")
        .groupBy("_first")
        .agg(F.count("*").alias("rows_lost"))
        .select(F.col("_first").alias("step"), F.get(names, F.col("_first") - 1).alias("column"), "rows_lost")
    )
    return marked.where("_first is null").drop("_first"), audit


def all_agree(cols: Sequence[str]) -> Column:
    """All columns equal; a null anywhere is a disagreement."""
    tests = [F.col(cols[0]) == F.col(c) for c in cols[1:]]
    return matches(reduce(lambda a, b: a & b, tests))


def agree(df: DataFrame, cols: Sequence[str], into: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose sources agree, collapsed to one column; and the share that did not."""
    same = all_agree(cols)
    kept = df.where(same).withColumn(into, F.col(cols[0])).drop(*[c for c in cols if c != into])
    audit = df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(~same).alias("n_disagree"),
        F.avg(F.when(same, 0.0).otherwise(1.0)).alias("share_disagree"),
    )
    return kept, audit


def in_window(day: Column, previous: Column, current: Column, anchor: Column, max_lag: int) -> Column:
    """Date between two grid dates (both included) and at most ``max_lag`` days after ``anchor``."""
    return matches(day.between(previous, current) & (F.datediff(day, anchor) <= max_lag))


def not_both(a: Column, b: Column) -> Column:
    """Negated conjunction that keeps rows where a side is null."""
    return ~matches(a & b)


def drop_extreme(df: DataFrame, value: str, tie: str) -> DataFrame:
    """All rows but the one with the largest value (ties: smallest ``tie``).

    The extreme row is found by a one-row aggregate, not by ranking the table.
    """
    top = F.max_by(F.col(tie), F.struct(F.col(value), -F.col(tie)))
    return df.where(F.col(tie) != df.where(F.col(value).isNotNull()).agg(top).scalar())


def pending(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has not been processed yet."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def load_audit(df: DataFrame, group: str, ok: Column) -> DataFrame:
    """Raw and usable row counts per group."""
    return df.groupBy(group).agg(
        F.count("*").alias("n_raw"), F.count_if(matches(ok)).alias("n_ok")
    )
