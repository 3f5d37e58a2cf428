"""Counts, profiles, cross-tabulations and other grouped summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F

from .quantiles import quantiles


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Row count per value combination and its share of all rows."""
    counts = df.groupBy(*cols).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / df.agg(F.count("*")).scalar())


def _long(row: DataFrame, names: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """One wide row ``<stat>_<i>`` to one row per name."""
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("variable"), *[F.col(f"{s}_{i}").alias(s) for s in stats])
            for i, n in enumerate(names)
        ]
    )
    return row.select(F.inline(entries))


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, quartiles and max, one row per column.

    The quartiles are exact and are computed when this function is called.
    """
    quart = quantiles(df, {c: (0.25, 0.5, 0.75) for c in cols})
    aggs = []
    for i, c in enumerate(cols):
        q = quart[c]
        aggs += [
            F.count(c).alias(f"count_{i}"),
            F.avg(c).alias(f"mean_{i}"),
            F.stddev_samp(c).alias(f"std_{i}"),
            F.min(c).cast("double").alias(f"min_{i}"),
            F.max(c).cast("double").alias(f"max_{i}"),
            *[F.lit(v).cast("double").alias(f"{p}_{i}") for p, v in zip(("p25", "p50", "p75"), q)],
        ]
    stats = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")
    return _long(df.agg(*aggs), cols, stats)


def quantile_table(df: DataFrame, levels: Mapping[str, Sequence[float]]) -> DataFrame:
    """Exact quantiles as rows (variable, level, value)."""
    found = quantiles(df, levels)
    rows = [(c, float(p), v) for c, ps in levels.items() for p, v in zip(ps, found[c])]
    return df.sparkSession.createDataFrame(rows, "variable string, level double, value double")


def missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and share of each column in one pass."""
    cols = list(cols or df.columns)
    aggs = []
    for i, c in enumerate(cols):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"n_missing_{i}"))
        aggs.append(F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)).alias(f"share_missing_{i}"))
    return _long(df.agg(*aggs), cols, ("n_missing", "share_missing"))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str] | None = None, other: str = "other") -> DataFrame:
    """Matrix of counts, zero where a combination does not occur.

    The column headings are the values found. Giving them saves the pass that looks them
    up; values that are not among them (nulls too) are then counted in the column ``other``.
    """
    if values is None:
        return df.groupBy(row).pivot(col).agg(F.count(F.lit(1))).fillna(0)
    listed = F.when(F.col(col).isin(list(values)), F.col(col)).otherwise(F.lit(other))
    return df.groupBy(row, listed.alias("_listed")).agg(F.count(F.lit(1)).alias("_n")).groupBy(row).pivot(
        "_listed", [*values, other]).agg(F.sum("_n")).fillna(0)


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations as rows (x, y, r), all pairs in one pass."""
    pairs = list(combinations_with_replacement(cols, 2))
    row = df.agg(*[F.corr(a, b).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)])
    entries = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r_{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*entries)))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Counts in equal-width bins between minimum and maximum (the maximum is in the last bin)."""
    limits = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    lo, hi = F.col("_limits.lo"), F.col("_limits.hi")
    step = F.floor(F.try_divide(F.col(col) - lo, (hi - lo) / bins)).cast("int")
    number = F.when(hi == lo, 1).otherwise(F.least(step + 1, F.lit(bins)))
    return (
        df.where(F.col(col).isNotNull())
        .select(col)
        .withColumn("_limits", limits)
        .groupBy(number.alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def rates(df: DataFrame, predicates: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Count and share of rows meeting each predicate (null counts as not met)."""
    aggs = [F.count("*").alias("n_rows")]
    for name, p in predicates.items():
        hit = F.coalesce(p, F.lit(False))
        aggs.append(F.count_if(hit).alias(f"n_{name}"))
        aggs.append(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias(f"share_{name}"))
    return (df.groupBy(*by) if by else df).agg(*aggs)


def normalised_means(df: DataFrame, cols: Sequence[str], total: str) -> DataFrame:
    """Per variable: non-null count and its mean as percent of the mean of ``total``."""
    aggs = []
    for i, c in enumerate(cols):
        aggs.append(F.count(c).alias(f"count_{i}"))
        aggs.append(F.try_divide(100 * F.avg(c), F.avg(total)).alias(f"percent_{i}"))
    return _long(df.agg(*aggs), cols, ("count", "percent"))


def collapse_values(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Distinct values of a group joined into one text, in alphabetical order.

    Meant for labels from a short list (the provenance of a row); copies of a
    (key, value) are dropped on the map side before the values of a key meet.
    """
    return df.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_set(value)), ", ").alias(out)
    )


def at_extremes(df: DataFrame, value: str, tie: str, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows holding the largest and the smallest value, as ``max_<c>`` and ``min_<c>``."""
    row = F.struct(*cols)
    sums = (df.groupBy(*by) if by else df).agg(
        F.max_by(row, F.struct(F.col(value), -F.col(tie))).alias("_max"),
        F.min_by(row, F.struct(F.col(value), F.col(tie))).alias("_min"),
    )
    return sums.select(
        *by,
        *[F.col(f"_max.{c}").alias(f"max_{c}") for c in cols],
        *[F.col(f"_min.{c}").alias(f"min_{c}") for c in cols],
    )


def vector_mean(df: DataFrame, by: Sequence[str], vector: str, size: int) -> DataFrame:
    """Componentwise mean of an array column per group.

    One ``avg`` per component keeps the aggregate map-side combined and needs no
    exploded rows; ``size`` is the fixed length of the vectors.
    """
    means = F.array(*[F.avg(F.get(vector, i)) for i in range(size)])
    return df.groupBy(*by).agg(means.alias(vector))


def coverage(df: DataFrame, day: str, entity: str) -> DataFrame:
    """Distinct entities and rows per (year, quarter), with a label such as 1998Q3."""
    return (
        df.groupBy(F.year(day).alias("year"), F.quarter(day).alias("quarter"))
        .agg(F.countDistinct(entity).alias("entities"), F.count("*").alias("n_rows"))
        .withColumn("label", F.concat("year", F.lit("Q"), "quarter"))
    )


def extremes_per_entity(df: DataFrame, entity: str, value: str, n: int, largest: bool = True) -> DataFrame:
    """The ``n`` entities with the largest (smallest) value, one row per entity."""
    best = (F.max if largest else F.min)(value).alias(value)
    order = F.desc(value) if largest else F.asc(value)
    return df.groupBy(entity).agg(best).orderBy(order, entity).limit(n)


def top_values(df: DataFrame, value: str, n: int) -> DataFrame:
    """Most frequent values, ties in value order."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), value).limit(n)


def cohort_profile(df: DataFrame, score: str, threshold: float, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Rows above a score threshold, one per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    high = df.where(F.col(score) > threshold).withColumn("_r", F.row_number().over(w))
    return high.where("_r = 1").drop("_r")
