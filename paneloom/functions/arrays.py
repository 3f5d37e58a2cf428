"""Array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def pair(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ends of an undirected pair in a fixed order."""
    return F.least(a, b), F.greatest(a, b)


def longest_run(items: Column, predicate: Callable[[Column], Column]) -> Column:
    """Length of the longest run of consecutive items that satisfy ``predicate``."""
    marks = F.array_join(F.transform(items, lambda x: F.when(predicate(x), "1").otherwise("0")), "")
    runs = F.transform(F.regexp_extract_all(marks, F.lit("1+"), 0), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def char_grams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is its own single gram."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def widen(vector: Column, size: int, prefix: str) -> list[Column]:
    """One column per vector component; for exports only."""
    return [F.get(vector, i).alias(f"{prefix}{i}") for i in range(size)]


def wrapped_list(items: Column, first: int = 2) -> Column:
    """Comma separated text with a line break after the first ``first`` items."""
    head = F.array_join(F.slice(items, 1, first), ", ")
    tail = F.array_join(F.slice(items, first + 1, F.greatest(F.size(items) - first, F.lit(0))), ", ")
    return F.when(F.size(items) > first, F.concat(head, F.lit(",\n"), tail)).otherwise(head)
