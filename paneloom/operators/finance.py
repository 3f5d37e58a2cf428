"""Statement cleaning, ratios and composite scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import linear_score
from .quantiles import quantiles

# Score ratios (numerator, denominator), their weights and winsorising levels.
SCORE_RATIOS = {
    "Ratio_A": ("EBIT", "totalAssets"),
    "Ratio_B": ("revenue", "totalAssets"),
    "Ratio_C": ("marketCap", "totalLiabilities"),
    "Ratio_D": ("totalCurrentAssets - totalCurrentLiabilities", "totalAssets"),
    "Ratio_E": ("retainedEarnings", "totalAssets"),
}
SCORE_WEIGHTS = {"Ratio_A": 3.3, "Ratio_B": 0.99, "Ratio_C": 0.6, "Ratio_D": 1.2, "Ratio_E": 1.4}
SCORE_LEVELS = {
    "Ratio_A": (0.025, 0.975),
    "Ratio_B": (0.025, 0.975),
    "Ratio_C": (0.05, 0.95),
    "Ratio_D": (0.025, 0.975),
    "Ratio_E": (0.025, 0.975),
}

# Liquidity, profitability, debt, operating and cash-flow ratios.
RATIOS = {
    "currentRatio": ("totalCurrentAssets", "totalCurrentLiabilities"),
    "quickRatio": ("totalCurrentAssets - inventory_balance_sheet", "totalCurrentLiabilities"),
    "cashRatio": ("cashAndCashEquivalents", "totalCurrentLiabilities"),
    "returnOnAssets": ("netIncome_income_statement", "totalAssets"),
    "returnOnEquity": ("netIncome_income_statement", "totalStockholdersEquity"),
    "returnOnCapitalEmployed": ("EBIT", "totalAssets - totalCurrentLiabilities"),
    "EBITtoRevenue": ("EBIT", "revenue"),
    "debtRatio": ("totalDebt", "totalAssets"),
    "debtRatioAlt": ("totalLiabilities", "totalAssets"),
    "debtEquityRatio": ("totalLiabilities", "totalStockholdersEquity"),
    "equityMultiplier": ("totalAssets", "totalStockholdersEquity"),
    "enterpriseValueMultiplier": ("marketCap + totalDebt - cashAndCashEquivalents", "ebitda"),
    "operatingCashFlowPerShare": ("operatingCashFlow", "weightedAverageShsOut"),
    "freeCashFlowPerShare": ("freeCashFlow", "weightedAverageShsOut"),
    "cashPerShare": ("cashAndCashEquivalents", "weightedAverageShsOut"),
    "operatingCashFlowToSales": ("operatingCashFlow", "revenue"),
    "freeCashFlowToOperatingCashFlow": ("freeCashFlow", "operatingCashFlow"),
}

# Identity checks, the first column must exceed the second.
IDENTITIES = (
    ("totalLiabilities", "totalCurrentLiabilities"),
    ("totalAssets", "totalCurrentAssets"),
    ("revenue", "EBIT"),
)

# Variables whose change against the previous period is kept.
DIFFERENCED = (
    ["Altman_Z", *SCORE_RATIOS]
    + ["grossProfitRatio", "ebitdaratio", "operatingIncomeRatio", "incomeBeforeTaxRatio", "netIncomeRatio"]
    + list(RATIOS)
)


def ratio_columns(definitions: Mapping[str, tuple[str, str]], zero_division: str = "null") -> dict[str, Column]:
    """Named ratio expressions.

    ``zero_division="null"`` gives null on a zero denominator. ``"clip"`` gives signed
    infinity (null for 0/0), which ``winsorise`` then clips to the outer bound.
    """
    out = {}
    for name, (num, den) in definitions.items():
        num, den = F.expr(num), F.expr(den)
        value = F.try_divide(num, den)
        if zero_division == "clip":
            limit = F.when(num > 0, float("inf")).when(num < 0, float("-inf"))
            value = F.when(den == 0, limit).otherwise(value)
        out[name] = value
    return out


def null_unless_greater(df: DataFrame, a: str, b: str) -> DataFrame:
    """Null both columns unless ``a > b``; a null on either side nulls both."""
    holds = F.col(a) > F.col(b)
    return df.withColumns({a: F.when(holds, F.col(a)), b: F.when(holds, F.col(b))})


def identity_checks(df: DataFrame, checks: Sequence[tuple[str, str]] = IDENTITIES) -> DataFrame:
    for a, b in checks:
        df = null_unless_greater(df, a, b)
    return df


def winsorise(df: DataFrame, levels: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Clip columns to their own quantiles; nulls stay null.

    The bounds of all columns are computed together, now, and enter the plan as
    literals: the rows themselves are only projected.
    """
    bounds = quantiles(df, levels)

    def clip(c: str) -> Column:
        lo, hi = bounds[c]
        if lo is None:
            return F.col(c)
        return F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(hi)), F.lit(lo)))

    return df.withColumns({c: clip(c) for c in levels})


def unit_fix(df: DataFrame, cols: Sequence[str], lo: float = 0.025, hi: float = 0.975, factor: float = 1000.0) -> DataFrame:
    """Divide whole thousands outside the outer quantiles by ``factor``.

    Zero is no whole thousand, and from 1e16 a double no longer prints as one.
    """
    bounds = quantiles(df, {c: (lo, hi) for c in cols})

    def fix(c: str) -> Column:
        x, (low, high) = F.col(c), bounds[c]
        if low is None:
            return x
        whole = (x % factor == 0) & (x != 0) & (F.abs(x) < 1e16)
        return F.when(whole & ((x < low) | (x > high)), x / factor).otherwise(x)

    return df.withColumns({c: fix(c) for c in cols})


def standardise(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population standard deviation; null where a column is constant."""
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
            *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)],
        )
    ).scalar()
    with_stats = df.withColumn("_stats", stats)
    scaled = {
        c + suffix: F.try_divide(F.col(c) - F.col(f"_stats.m_{i}"), F.col(f"_stats.s_{i}"))
        for i, c in enumerate(cols)
    }
    return with_stats.withColumns(scaled).drop("_stats")


def altman(df: DataFrame, into: str = "Altman_Z") -> DataFrame:
    return df.withColumn(into, linear_score(SCORE_WEIGHTS))


def differences(pairs: Mapping[str, tuple[str, str]]) -> dict[str, Column]:
    """``name -> current - previous`` for a family of column pairs."""
    return {name: F.col(now) - F.col(before) for name, (now, before) in pairs.items()}
