"""Exact quantiles of many columns at any size.

The value range that must contain each wanted rank is narrowed by passes of
``percentile_approx`` (one aggregate for all columns and levels; each pass shrinks a range
about ``ACCURACY / 4`` fold, by its guaranteed rank error), until it holds few enough values
to be counted and sorted in one task. A range is verified by counting, so a bad bracket
costs another pass and never a wrong result. Only bounds and results reach the driver.
Every column takes this one path; how many passes it needs does not change a value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

# Values of one column that may be sorted in one task.
SMALL = 500_000
ACCURACY = 10_000


def _interpolated(n: int, p: float) -> tuple[int, int, float]:
    position = (n - 1) * p
    low = int(position)
    return low, min(low + 1, n - 1), position - low


def _between(low: float, high: float, part: float) -> float:
    """The point between two neighbours; equal ones (also infinities) are returned as they are."""
    return low if low == high or not part else (1 - part) * low + part * high


def _inside(c: str, lo, hi):
    test = F.col(c).isNotNull()
    return test if lo is None else test & (F.col(c) >= lo) & (F.col(c) <= hi)


def _pick(df: DataFrame, targets: Sequence[tuple]) -> dict[tuple[str, int], float]:
    """Values at ranks inside brackets: targets are (column, lo, hi, rows below, ranks)."""
    entries = [
        F.struct(F.lit(i).alias("i"), F.when(_inside(c, lo, hi), F.col(c).cast("double")).alias("v"))
        for i, (c, lo, hi, _, _) in enumerate(targets)
    ]
    counts = (
        df.select(F.inline(F.array(*entries)))
        .where("v is not null")
        .groupBy("i", "v")
        .agg(F.count("*").alias("n"))
    )
    running = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(running))
    tests = [
        (F.col("i") == i) & (F.col("upto") > k - below) & (F.col("upto") - F.col("n") <= k - below)
        for i, (_, _, _, below, ks) in enumerate(targets)
        for k in ks
    ]
    found = {}
    for row in ranked.where(reduce(lambda a, b: a | b, tests)).collect():
        c, _, _, below, ks = targets[row["i"]]
        for k in ks:
            if row["upto"] - row["n"] <= k - below < row["upto"]:
                found[c, k] = row["v"]
    return found


def _select(df: DataFrame, want: Mapping[str, Sequence[int]], n: Mapping[str, int], small: int, accuracy: int) -> dict:
    """Exact order statistics (0-based ranks) of several columns by bracketing."""
    # (column, rank) -> lowest value, highest value (both included), rows below, rows in it
    open_ = {(c, k): (None, None, 0, n[c]) for c, ks in want.items() for k in ks}
    ready: dict[tuple, list[int]] = {}
    found: dict[tuple[str, int], float] = {}
    while open_:
        groups: dict[tuple, list[int]] = {}
        for (c, k), bracket in list(open_.items()):
            lo, hi, below, size = bracket
            if lo is not None and lo == hi:
                found[c, k] = lo
                del open_[c, k]
            elif size <= small:
                ready.setdefault((c, lo, hi, below), []).append(k)
                del open_[c, k]
            else:
                # Ranks of a column that share a bracket share one sketch.
                groups.setdefault((c, bracket), []).append(k)
        if not groups:
            break
        todo, slack = list(groups.items()), 2.0 / accuracy
        exprs = []
        for (c, (lo, hi, below, size)), ks in todo:
            around = [min(max((k - below) / size + d, 0.0), 1.0) for k in ks for d in (-slack, slack)]
            exprs.append(F.percentile_approx(F.when(_inside(c, lo, hi), F.col(c)), around, accuracy))
        sketches = df.agg(*[e.alias(f"r{i}") for i, e in enumerate(exprs)]).first()
        pending = [
            ((c, k), *sketches[i][2 * j : 2 * j + 2])
            for i, ((c, _), ks) in enumerate(todo)
            for j, k in enumerate(ks)
        ]
        checks = []
        for (c, _), a, b in pending:
            checks += [F.count_if(F.col(c) < a), F.count_if((F.col(c) >= a) & (F.col(c) <= b))]
        counts = df.agg(*[e.alias(f"c{i}") for i, e in enumerate(checks)]).first()
        for i, ((c, k), a, b) in enumerate(pending):
            below, size = counts[2 * i], counts[2 * i + 1]
            old = open_[c, k]
            if not below <= k < below + size or size >= old[3]:
                # Not bracketed, or no narrower (one value repeated): split at a value instead.
                a, b, below, size = _split(df, c, k, old)
            open_[c, k] = (a, b, below, size)
    if ready:
        found.update(_pick(df, [(*bracket, ks) for bracket, ks in ready.items()]))
    return found


def _split(df: DataFrame, c: str, k: int, bracket: tuple) -> tuple:
    """Halve a bracket at a middle value; keeps the half that holds rank ``k``."""
    lo, hi, below, size = bracket
    col = F.col(c)
    if lo is None:
        lo, hi = df.agg(F.min(c), F.max(c)).first()
    mid = lo + (hi - lo) / 2
    if not lo <= mid < hi:
        mid = lo
    inside = (col >= lo) & (col <= hi)
    left = inside & (col <= mid)
    n_left, top_left, bottom_right = df.agg(
        F.count_if(left), F.max(F.when(left, col)), F.min(F.when(inside & (col > mid), col))
    ).first()
    if k < below + n_left:
        return lo, top_left, below, n_left
    return bottom_right, hi, below + n_left, size - n_left


def _regions(df: DataFrame, brackets: Mapping[str, Sequence[tuple]], want: Mapping[str, Sequence[int]]) -> dict[tuple[str, int], float]:
    """Values at ranks that lie inside the brackets of their column; ranks that do not are missing from the result.

    One pass: a value is counted by itself inside a bracket, and with its region between two
    brackets otherwise, so the running count places every rank exactly.
    """
    entries = []
    for i, (c, ranges) in enumerate(brackets.items()):
        region, col = F.lit(2 * len(ranges)), F.col(c)
        for j, (lo, hi) in reversed(list(enumerate(ranges))):
            region = F.when(col < lo, 2 * j).when(col <= hi, 2 * j + 1).otherwise(region)
        entries.append(F.struct(F.lit(i).alias("i"), F.when(col.isNotNull(), region).alias("region"), col.cast("double").alias("v")))
    counts = (
        df.select(F.inline(F.array(*entries))).where("region is not null")
        .groupBy("i", "region", F.when(F.col("region") % 2 == 1, F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    )
    running = Window.partitionBy("i").orderBy("region", "v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(running))
    cols = list(brackets)
    tests = [(F.col("i") == cols.index(c)) & (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k) for c in cols for k in want[c]]
    found = {}
    for row in ranked.where((F.col("region") % 2 == 1) & reduce(lambda x, y: x | y, tests)).collect():
        c = cols[row["i"]]
        found |= {(c, k): row["v"] for k in want[c] if row["upto"] - row["n"] <= k < row["upto"]}
    return found


def _merged(ranges: Sequence[tuple]) -> list[tuple]:
    """The ranges in order, overlapping ones as one."""
    out: list[tuple] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def quantiles(
    df: DataFrame,
    levels: Mapping[str, Sequence[float]],
    small: int = SMALL,
    accuracy: int = ACCURACY,
) -> dict[str, list[float | None]]:
    """Linearly interpolated exact quantiles per column (runs the aggregates now).

    The first aggregate counts and sketches all columns together; the second looks the ranks up
    inside the brackets of the sketch. Ranks that it does not find, and all if the brackets would
    hold too many values for a sort, are narrowed further. Infinities are values like
    others: between equal neighbours no sum is formed.
    """
    cols, slack = list(levels), 4.0 / accuracy
    exprs = [F.count(c).alias(f"n{i}") for i, c in enumerate(cols)]
    for i, c in enumerate(cols):
        around = [min(max(p + d, 0.0), 1.0) for p in levels[c] for d in (-slack, slack)]
        exprs.append((F.percentile_approx(c, around, accuracy) if around else F.lit(None)).alias(f"q{i}"))
    first = df.agg(*exprs).first()
    sizes = {c: first[f"n{i}"] for i, c in enumerate(cols)}
    out: dict[str, list[float | None]] = {c: [None] * len(levels[c]) for c in cols}
    places = {c: [_interpolated(sizes[c], p) for p in levels[c]] for c in cols if sizes[c] and levels[c]}
    want = {c: sorted({k for lo, hi, _ in ps for k in (lo, hi)}) for c, ps in places.items()}
    stats: dict[tuple[str, int], float] = {}
    within = 6 * slack * max((sizes[c] * len(levels[c]) for c in want), default=0)
    if want and within <= small and min(sizes[c] for c in want) > 4 / slack:
        brackets = {c: _merged(list(zip(first[f"q{i}"][::2], first[f"q{i}"][1::2]))) for i, c in enumerate(cols) if c in want}
        stats = _regions(df, brackets, want)
    missing = {c: [k for k in ks if (c, k) not in stats] for c, ks in want.items()}
    missing = {c: ks for c, ks in missing.items() if ks}
    if missing:
        stats |= _select(df, missing, sizes, small, accuracy)
    for c, ps in places.items():
        out[c] = [_between(float(stats[c, lo]), float(stats[c, hi]), part) for lo, hi, part in ps]
    return out


def order_statistics(df: DataFrame, col: str, ranks: Sequence[int], small: int = SMALL) -> list[float]:
    """Exact values at 0-based ranks of one column (runs the aggregates now)."""
    total = df.agg(F.count(col)).first()[0]
    found = _select(df, {col: sorted(set(ranks))}, {col: total}, small, ACCURACY)
    return [found[col, k] for k in ranks]
