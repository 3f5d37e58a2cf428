"""Evaluation of classifiers from prediction tables (.., truth, prediction).

All metrics are aggregates; the long form has one more column, ``model``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import encode, ratio
from .windows import with_class_value


def correct(truth: str = "truth", prediction: str = "prediction") -> Column:
    return F.coalesce(F.col(truth) == F.col(prediction), F.lit(False))


def _share(p: Column) -> Column:
    return F.avg(F.when(p, 1.0).otherwise(0.0))


def class_counts(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """True positives, predicted and actual rows per class (in truth or prediction)."""
    pairs = pred.groupBy(*by, "truth", "prediction").agg(F.count("*").alias("n"))
    sides = pairs.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("truth").alias("label"), F.lit(0).alias("side")),
                F.struct(F.col("prediction").alias("label"), F.lit(1).alias("side")),
            )
        ).alias("_e"),
        "n",
        (F.col("truth") == F.col("prediction")).alias("_hit"),
    ).select(*by, "_e.*", "n", "_hit")
    actual, n = F.col("side") == 0, F.col("n")
    return sides.groupBy(*by, "label").agg(
        F.sum(F.when(actual & F.col("_hit"), n).otherwise(0)).alias("tp"),
        F.sum(F.when(~actual, n).otherwise(0)).alias("predicted"),
        F.sum(F.when(actual, n).otherwise(0)).alias("support"),
    )


def class_report(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; an undefined metric is 0."""
    zero = F.lit(0.0)
    precision = F.coalesce(ratio(F.col("tp"), F.col("predicted")), zero)
    recall = F.coalesce(ratio(F.col("tp"), F.col("support")), zero)
    f1 = F.coalesce(ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")), zero)
    return class_counts(pred, by).select(
        *by, "label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support"
    )


def weighted_average(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support-weighted precision, recall and F1."""
    total = F.sum("support")
    means = [ratio(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in ("precision", "recall", "f1")]
    return (report.groupBy(*by) if by else report).agg(*means, total.alias("support"))


def summary(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, weighted F1 and share of the most frequent true class."""
    counts = class_counts(pred, by)
    f1 = F.coalesce(ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")), F.lit(0.0))
    total = F.sum("support")
    return (counts.groupBy(*by) if by else counts).agg(
        total.alias("n"),
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / total).alias("weighted_f1"),
        (F.max("support") / total).alias("majority_share"),
    )


def ordinal_shares(pred: DataFrame, codes: Mapping[str, int], within: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Share of exact hits and of predictions at most ``within`` classes away."""
    gap = F.abs(encode(F.col("truth"), codes) - encode(F.col("prediction"), codes))
    near = F.coalesce(gap <= within, F.lit(False))
    return (pred.groupBy(*by) if by else pred).agg(
        _share(correct()).alias("exact"), _share(near).alias(f"within_{within}")
    )


def confusion(pred: DataFrame, classes: Sequence[str] | None = None, by: Sequence[str] = (), other: str = "other") -> DataFrame:
    """Confusion matrix, per group of ``by``, with every class as row and column, zero-filled.

    The classes are those found in truth or prediction. Where a list is given, whatever is
    not on it (nulls too) is counted under ``other``.
    """
    cells = pred.groupBy(*by, "truth", "prediction").agg(F.count(F.lit(1)).alias("_n"))
    if classes is None:
        found = cells.select("truth").union(cells.select("prediction")).distinct().where("truth is not null")
        heads = sorted(r[0] for r in found.collect())  # classes, of which there are few
    else:
        heads = [*classes, other]
        for c in ("truth", "prediction"):
            cells = cells.withColumn(c, F.when(F.col(c).isin(list(classes)), F.col(c)).otherwise(F.lit(other)))
    counts = cells.groupBy(*by, "truth").pivot("prediction", heads).agg(F.sum("_n"))
    rows = pred.sparkSession.createDataFrame([(c,) for c in heads], "truth string")
    if by:
        rows = pred.select(*by).distinct().crossJoin(F.broadcast(rows))  # a row for each class
    return rows.join(counts, [*by, "truth"], "left").fillna(0)


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * rows of the class) per class: one small table to join on ``label``."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))).scalar()
    t = counts.withColumn("_t", totals)
    return t.withColumn("weight", F.col("_t.n") / (F.col("_t.k") * F.col("n"))).drop("_t")


def with_balanced_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Attach the balanced weight of its class to each row."""
    return with_class_value(df, balanced_weights(df, label).withColumnRenamed("weight", out), label, out)


def aligned(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two models' predictions for the same rows, side by side."""
    one = a.select(*keys, "truth", F.col("prediction").alias("prediction_1"))
    two = b.select(*keys, F.col("prediction").alias("prediction_2"))
    return one.join(two, list(keys))


def agreement_table(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """2x2 table of right and wrong predictions of two models, and McNemar's statistics.

    The statistics are null where the models never disagree on being right.
    """
    one, two = correct("truth", "prediction_1"), correct("truth", "prediction_2")
    cells = (pairs.groupBy(*by) if by else pairs).agg(
        F.count_if(one & two).alias("both_right"),
        F.count_if(one & ~two).alias("only_1_right"),
        F.count_if(~one & two).alias("only_2_right"),
        F.count_if(~one & ~two).alias("both_wrong"),
    )
    b, c = F.col("only_1_right"), F.col("only_2_right")
    gap = F.abs(b - c)
    return cells.withColumns(
        {
            "chi2": ratio(gap * gap, b + c),
            "chi2_corrected": ratio((gap - 1) * (gap - 1), b + c),
        }
    )


def mcnemar_p_values(only_1: int, only_2: int) -> dict[str, float | None]:
    """p-values of McNemar's test: plain, continuity corrected, exact binomial.

    Chi-square with one degree of freedom has survival function erfc(sqrt(x / 2)).
    """
    n, gap = only_1 + only_2, abs(only_1 - only_2)
    if n == 0:
        return {"plain": None, "corrected": None, "exact": None}
    plain = math.erfc(math.sqrt(gap**2 / n / 2))
    corrected = math.erfc(math.sqrt((gap - 1) ** 2 / n / 2))
    return {"plain": plain, "corrected": corrected, "exact": min(1.0, 2 * _lower_tail(min(only_1, only_2), n))}


def _lower_tail(k: int, n: int) -> float:
    """P(X <= k) of a fair binomial of n, for k up to n / 2.

    The terms fall by the factor j / (n - j + 1) from k downwards, so the sum stops after a
    number of terms that does not grow with n beyond the square root.
    """
    term = total = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    for j in range(k, 0, -1):
        term *= j / (n - j + 1)
        total += term
        if term < total * 1e-17:
            break
    return total


def mcnemar(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Agreement table with p-values (collects one row per model pair, runs now)."""
    table = agreement_table(pairs, by)
    rows = []
    for r in table.collect():
        p = mcnemar_p_values(r["only_1_right"], r["only_2_right"])
        rows.append((*r, p["plain"], p["corrected"], p["exact"]))
    extra = ("p_plain", "p_corrected", "p_exact")
    schema = table.schema
    for name in extra:
        schema = schema.add(name, "double")
    return pairs.sparkSession.createDataFrame(rows, schema)


def model_pairs(predictions: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Aligned predictions of several model pairs out of one long prediction table.

    Each row is sent once per pair it takes part in, then grouped by row and pair, so
    the long table is shuffled once however many pairs there are.
    """
    roles: dict[str, list[tuple[int, int]]] = {}
    for i, (one, two) in enumerate(pairs):
        roles.setdefault(one, []).append((i, 1))
        roles.setdefault(two, []).append((i, 2))
    part = F.array().cast("array<struct<pair:int,side:int>>")
    for model, uses in roles.items():
        slots = F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(s).alias("side")) for p, s in uses])
        part = F.when(F.col("model") == model, slots).otherwise(part)
    label = F.array(*[F.struct(F.lit(a).alias("model_1"), F.lit(b).alias("model_2")) for a, b in pairs])
    return (
        predictions.select(*keys, "truth", "prediction", F.explode(part).alias("_u"))
        .select(*keys, "truth", "prediction", "_u.*")
        .groupBy(*keys, "pair")
        .agg(
            F.max(F.when(F.col("side") == 1, F.col("truth"))).alias("truth"),
            F.max(F.when(F.col("side") == 1, F.col("prediction"))).alias("prediction_1"),
            F.max(F.when(F.col("side") == 2, F.col("prediction"))).alias("prediction_2"),
            F.bit_or("side").alias("_sides"),
        )
        .where("_sides = 3")
        .select(*keys, F.get(label, F.col("pair")).alias("_l"), "truth", "prediction_1", "prediction_2")
        .select(*keys, "_l.*", "truth", "prediction_1", "prediction_2")
    )


def agreement_of_all(predictions: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Agreement table of every pair of models, from one count of who was right.

    A row's key gathers a bit for each model that has it and one for each that is right; patterns are
    counted, and the pairs follow from the few patterns that occur. Keys that one model of a
    pair lacks do not count for the pair.
    """
    bit = F.create_map(*[F.lit(x) for i, m in enumerate(models) for x in (m, 1 << i)])[F.col("model")].cast("long")
    seen = predictions.where(F.col("model").isin(list(models))).groupBy(*keys).agg(
        F.bit_or(bit).alias("has"), F.bit_or(F.when(correct(), bit).otherwise(F.lit(0).cast("long"))).alias("right"))
    patterns = seen.groupBy("has", "right").agg(F.count("*").alias("n"))
    pairs = F.array(*[
        F.struct(F.lit(a).alias("model_1"), F.lit(b).alias("model_2"), F.lit(1 << i).cast("long").alias("x"), F.lit(1 << j).cast("long").alias("y"))
        for i, a in enumerate(models) for j, b in enumerate(models) if a < b])
    rows = patterns.select("has", "right", "n", F.inline(pairs))
    one, two = (F.col("right").bitwiseAND(F.col(c)) != 0 for c in ("x", "y"))
    both = (F.col("has").bitwiseAND(F.col("x")) != 0) & (F.col("has").bitwiseAND(F.col("y")) != 0)
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return rows.where(both).groupBy("model_1", "model_2").agg(
        total(one & two).alias("both_right"), total(one & ~two).alias("only_1_right"),
        total(~one & two).alias("only_2_right"), total(~one & ~two).alias("both_wrong"))


def p_value_block(table: DataFrame, digits: int = 4) -> DataFrame:
    """An agreement table with p-values as text, ``-`` where two models never differ (a row for each pair, runs now)."""
    shown = lambda p: "-" if p is None else f"{p:.{digits}f}"
    rows = []
    for r in table.collect():
        p = mcnemar_p_values(r["only_1_right"], r["only_2_right"])
        rows.append((*r, shown(p["plain"]), shown(p["corrected"]), shown(p["exact"])))
    schema = table.schema
    for name in ("p_plain", "p_corrected", "p_exact"):
        schema = schema.add(name, "string")
    return table.sparkSession.createDataFrame(rows, schema)


def family_table(families: Mapping[str, DataFrame], baselines: Mapping[str, DataFrame], common: str = "Most Common Class Baseline") -> DataFrame:
    """Accuracy of all models of all families, of a majority-class row, and of baselines with predictions of their own.

    families: name -> long predictions (model, truth, prediction). baselines: name -> (truth, prediction).
    """
    rate = F.avg(F.when(correct(), 1.0).otherwise(0.0)).alias("accuracy")
    parts, shares = [], []
    for family, p in families.items():
        found = summary(p, ["model"])
        parts.append(found.select("model", F.lit(family).alias("family"), "accuracy"))
        shares.append(found.select("majority_share"))
    majority = reduce(DataFrame.unionAll, shares).agg(F.max("majority_share").alias("accuracy"))
    parts.append(majority.select(F.lit(common).alias("model"), F.lit("baseline").alias("family"), "accuracy"))
    for name, p in baselines.items():
        parts.append(p.agg(rate).select(F.lit(name).alias("model"), F.lit("baseline").alias("family"), "accuracy"))
    return reduce(DataFrame.unionByName, parts)


def comparison(predictions: DataFrame, codes: Mapping[str, int], baseline: str = "Most Common Class Baseline") -> DataFrame:
    """One row per model (accuracy, weighted F1, within one) and a majority-class row."""
    table = summary(predictions, ["model"]).join(ordinal_shares(predictions, codes, by=["model"]), "model")
    rows = table.select("model", "accuracy", "weighted_f1", "within_1")
    common = table.agg(F.max("majority_share").alias("accuracy")).select(
        F.lit(baseline).alias("model"),
        "accuracy",
        F.lit(None).cast("double").alias("weighted_f1"),
        F.lit(None).cast("double").alias("within_1"),
    )
    return rows.unionByName(common)


def restricted(predictions: DataFrame, population: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions for the rows of another population only."""
    return predictions.join(population.select(*keys).distinct(), list(keys), "left_semi")
