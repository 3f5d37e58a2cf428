"""String expressions: cleaning, matching, counting, formatting."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, functions as F


def strip_chars(col: Column, *chars: str) -> Column:
    """Strip each of ``chars`` from both ends, one after the other."""
    return reduce(lambda c, ch: F.btrim(c, F.lit(ch)), chars, col)


def replace_chain(col: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements applied in the given order."""
    return reduce(lambda c, rule: F.replace(c, F.lit(rule[0]), F.lit(rule[1])), rules, col)


def remove_patterns(col: Column, patterns: Iterable[str]) -> Column:
    """Regex removals applied in the given order."""
    return reduce(lambda c, p: F.regexp_replace(c, p, ""), patterns, col)


def override(col: Column, source: Column, exact: Mapping[str, str]) -> Column:
    """Value from ``exact`` where ``source`` equals one of its keys, else ``col``."""
    return reduce(lambda c, kv: F.when(source == kv[0], kv[1]).otherwise(c), exact.items(), col)


def matches(predicate: Column) -> Column:
    """A predicate that is False, not null, where its input is null."""
    return F.coalesce(predicate, F.lit(False))


def cut_from(col: Column, keyword: str) -> Column:
    """Text from the first case-insensitive ``keyword`` on; unchanged if it is absent."""
    at = F.locate(keyword.lower(), F.lower(col))
    return F.when(at > 0, F.substring(col, at, F.length(col))).otherwise(col)


def count_occurrences(col: Column, needle: str, fold_case: bool = True) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    text = F.lower(col) if fold_case else col
    needle = needle.lower() if fold_case else needle
    gone = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return (gone / len(needle)).cast("long")


def split_first(col: Column, pattern: str) -> Column:
    """Array of the part before the first delimiter and the rest."""
    return F.split(col, pattern, 2)


def recode_by_substring(col: Column, recodes: Mapping[str, str]) -> Column:
    """First key contained in the text decides the new label; otherwise the text stays."""
    out = col
    for needle, label in reversed(list(recodes.items())):
        out = F.when(col.contains(needle), label).otherwise(out)
    return out


def number_between(col: Column, opening: str, closing: str) -> Column:
    """Number written between the first ``opening`` and the next ``closing`` mark, or null."""
    pattern = rf"^[^{opening}]*[{opening}]([^{opening}{closing}]*)"
    return F.trim(F.regexp_extract(col, pattern, 1)).try_cast("double")


def thousands(col: Column) -> Column:
    """Integer with thousands separators."""
    return F.format_number(col, 0)


def percent(col: Column, decimals: int = 2) -> Column:
    """A share printed as percent."""
    return F.format_string(f"%.{decimals}f%%", col * 100)


def collapse_newlines(col: Column) -> Column:
    return F.regexp_replace(col, r"\n+", "\n")
