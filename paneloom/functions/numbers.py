"""Numeric expressions: guarded ratios, codes, scores, vector products."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def ratio(num: Column, den: Column) -> Column:
    """Quotient, null on a zero denominator (also under ANSI mode)."""
    return F.try_divide(num, den)


def finite(col: Column) -> Column:
    """Null instead of NaN and infinities."""
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), None).otherwise(col)


def ranks(order: Sequence[str], best_first: bool = True) -> dict[str, int]:
    """Codes 1..n; the best class gets n."""
    worst_first = reversed(order) if best_first else order
    return {label: i for i, label in enumerate(worst_first, 1)}


def encode(col: Column, codes: Mapping[str, int]) -> Column:
    """Code of a label; null for labels without a code."""
    out = F.lit(None).cast("int")
    for label, code in codes.items():
        out = F.when(col == label, code).otherwise(out)
    return out


def decode(col: Column, codes: Mapping[str, int]) -> Column:
    out = F.lit(None).cast("string")
    for label, code in codes.items():
        out = F.when(col == code, label).otherwise(out)
    return out


def at_least(col: Column, threshold: float) -> Column:
    """Threshold flag; a null value gives False."""
    return F.coalesce(col >= threshold, F.lit(False))


def smoothed_log_ratio(pos: Column, neg: Column) -> Column:
    return F.log10((pos + 1) / (neg + 1))


def linear_score(weights: Mapping[str, float]) -> Column:
    total = None
    for name, weight in weights.items():
        term = F.lit(weight) * F.col(name)
        total = term if total is None else total + term
    return total


def ordinal_distance(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
