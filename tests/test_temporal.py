"""Histories, fills, quantiles and statement cleaning on hand-made tables."""

import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from paneloom.operators import finance as fin
from paneloom.operators import windows as wn
from paneloom.operators.aggregates import histogram, profile
from paneloom.operators.quantiles import order_statistics, quantiles

D = date


def test_neighbours_equal_plain_window_with_hot_key(spark):
    rng = random.Random(3)
    data = [("hot" if i % 3 == 0 else f"k{i % 9}", D(2000 + rng.randrange(6), rng.randrange(1, 13), rng.randrange(1, 28)), i, None if i % 11 == 0 else i % 5) for i in range(2000)]
    df = spark.createDataFrame(data, "k string, d date, id int, g int")
    w = Window.partitionBy("k").orderBy("d", "id")
    plain = df.select("k", "d", "id", F.lag("g").over(w), F.lag("d").over(w), F.lead("g").over(w), F.lead("id").over(w))
    for span in ("year", "month", None):
        out = wn.neighbours(df, ["k"], ["d", "id"], ["g", "d"], ["g", "id"], span=span)
        got = out.select("k", "d", "id", "previous_g", "previous_d", "next_g", "next_id")
        assert sorted(map(str, got.collect())) != [] and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_history_rules(spark):
    data = [
        ("S", "solo", D(2010, 5, 5), 1, "A", 8), ("S", "x", D(2010, 1, 1), 2, "A", 8), ("S", "x", D(2010, 1, 1), 3, "A", 8),
        ("S", "x", D(2011, 1, 1), 4, "BB", 6), ("S", "x", D(2012, 1, 1), 5, "NR", None), ("S", "x", D(2013, 1, 1), 6, "AA", 9),
        ("M", "x", D(2010, 2, 2), 7, "AA", 9), ("M", "x", D(2013, 2, 2), 8, "AAA", 10)]
    df = spark.createDataFrame(data, "agency string, entity string, day date, tie int, grade string, rank int")
    out = wn.neighbours(df, ["agency", "entity"], ["day", "tie"], previous=["grade", "rank"], flag="earlier").withColumn(
        "kind", wn.event_type(first=~F.col("earlier")))
    got = {r["tie"]: (r["kind"], r["step"]) for r in out.withColumn("step", wn.signed_step(F.col("kind"))).collect()}
    assert got == {
        1: ("Ambiguous", None), 2: ("Ambiguous", None), 3: ("Affirmation", 0), 4: ("Downgrade", -2),
        5: ("Change", None), 6: ("Change", None), 7: ("Ambiguous", None), 8: ("Upgrade", 1)}
    closed = wn.validity(df, ["agency", "entity"], ["day", "tie"], D(2016, 12, 31))
    ends = {r["tie"]: r["valid_to"] for r in closed.collect()}
    assert ends[2] == D(2010, 1, 1) and ends[3] == D(2011, 1, 1) and ends[1] == ends[6] == ends[8] == D(2016, 12, 31)


def test_fill_forward(spark):
    data = [("a", datetime(2024, 1, 2, 9), 1, 1.0), ("a", datetime(2024, 1, 2, 10), 2, 2.0), ("a", datetime(2024, 1, 4), 3, None), ("a", datetime(2024, 1, 5), 4, 5.0), ("b", datetime(2023, 12, 31), 5, 7.0), ("b", datetime(2024, 1, 6), 6, 8.0)]
    df = spark.createDataFrame(data, "k string, t timestamp, id int, v double")
    got = sorted(tuple(r) for r in wn.fill_forward(df, "k", "t", "v", D(2024, 1, 1), D(2024, 1, 6), ["id"]).collect())
    assert got == [("a", D(2024, 1, 2), 2.0), ("a", D(2024, 1, 3), 2.0), ("a", D(2024, 1, 4), 2.0), ("a", D(2024, 1, 5), 5.0), ("a", D(2024, 1, 6), 5.0), ("b", D(2024, 1, 6), 8.0)]


def test_rank_filter_is_pushed_below_the_shuffle(spark, folder):
    from paneloom.plans import QUERIES

    plan = QUERIES["wn10_top_k"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan.split("WindowGroupLimit")[-1]


@pytest.mark.parametrize("small,accuracy", [(10**6, 10_000), (50, 100), (5, 20)])
def test_quantiles_equal_numpy(spark, small, accuracy):
    rng = np.random.default_rng(5)
    x = rng.normal(size=4000) * 10 ** rng.integers(0, 6, 4000)
    y = np.where(rng.random(4000) < 0.6, 7.0, rng.integers(0, 50, 4000).astype(float))
    data = [(float(a), float(b), None) for a, b in zip(x, y)]
    df = spark.createDataFrame(data, "x double, y double, z double")
    levels = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    got = quantiles(df, {c: levels for c in "xyz"}, small=small, accuracy=accuracy)
    np.testing.assert_allclose(got["x"], np.quantile(x, levels), rtol=1e-12)
    np.testing.assert_allclose(got["y"], np.quantile(y, levels), rtol=1e-12)
    assert got["z"] == [None] * 6


def test_order_statistics_of_infinite_values(spark):
    df = spark.createDataFrame([(v,) for v in [float("-inf")] * 40 + [1.0, 2.0, 3.0] + [float("inf")] * 40], "x double")
    assert order_statistics(df, "x", [0, 41, 82], small=2) == [float("-inf"), 2.0, float("inf")]


def test_ratios_and_winsorise(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (4.0, 2.0), (None, 1.0)], "a double, b double")
    null = df.select(fin.ratio_columns({"r": ("a", "b")})["r"].alias("r"))
    assert [r[0] for r in null.collect()] == [None, None, None, 2.0, None]
    clip = df.select(fin.ratio_columns({"r": ("a", "b")}, "clip")["r"].alias("r"))
    assert [r[0] for r in clip.collect()] == [float("inf"), float("-inf"), None, 2.0, None]
    x = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "x double")
    out = [r[0] for r in fin.winsorise(x, {"x": (0.05, 0.95)}).collect()]
    assert min(v for v in out if v is not None) == 5.0 and max(v for v in out if v is not None) == 95.0 and out.count(None) == 1
    same = spark.createDataFrame([(3.0,)] * 4, "x double")
    assert {r[0] for r in fin.winsorise(same, {"x": (0.05, 0.95)}).collect()} == {3.0}


def test_unit_fix(spark):
    values = [float(i) for i in range(1, 2000) if i != 1000] + [0.0, 1000.0, 5_000_000.0, 1e16, 1234567.5, -3000.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    after = dict(fin.unit_fix(df, ["v"]).collect())
    by_value = {v: after[i] for i, v in enumerate(values)}
    assert by_value[0.0] == 0.0 and by_value[1000.0] == 1000.0 and by_value[5_000_000.0] == 5000.0
    assert by_value[1e16] == 1e16 and by_value[1234567.5] == 1234567.5 and by_value[-3000.0] == -3.0


def test_identity_check_nulls_both(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (None, 1.0), (1.0, None)], "a double, b double")
    assert [tuple(r) for r in fin.null_unless_greater(df, "a", "b").collect()] == [(2.0, 1.0)] + [(None, None)] * 4


def test_profile_and_histogram_edges(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None)], "x double, y double")
    got = {r["variable"]: r for r in profile(df, ["x", "y"]).collect()}
    assert got["x"]["p50"] == 2.0 and got["x"]["std"] == 1.0 and got["y"]["count"] == 0 and got["y"]["p50"] is None
    assert sorted(tuple(r) for r in histogram(df, "x", 2).collect()) == [(1, 1), (2, 2)]
    one = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert [tuple(r) for r in histogram(one, "x", 5).collect()] == [(1, 2)]


def test_group_statistics_and_average_rank(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("b", 2)], "g string, v int")
    assert sorted(tuple(r) for r in wn.group_stat(df, ["g"], m=F.max("v")).collect()) == [("a", 1, 3), ("a", 3, 3), ("a", 3, 3), ("b", 2, 2)]
    assert sorted((r["g"], r["v"], r["rank"]) for r in wn.average_rank(df, ["g"], "v").collect()) == [("a", 1, 3), ("a", 3, 1), ("a", 3, 1), ("b", 2, 1)]


@pytest.mark.parametrize("small,accuracy", [(10**6, 10_000), (20, 100), (3, 20)])
def test_quantiles_of_infinities(spark, small, accuracy):
    inf = float("inf")
    values = [float(i) for i in range(800)] + [inf] * 100 + [-inf] * 100
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert quantiles(df, {"x": [0.0, 0.05, 0.9751, 1.0]}, small=small, accuracy=accuracy)["x"] == [-inf, -inf, inf, inf]
    ranked = sorted(values)
    assert quantiles(df, {"x": [0.5]}, small=small, accuracy=accuracy)["x"] == [(ranked[499] + ranked[500]) / 2]


def test_a_null_earlier_grade_is_not_a_first_row(spark):
    data = [("x", D(2010, 1, 1), 1, None, None), ("x", D(2011, 1, 1), 2, "A", 8), ("x", D(2012, 1, 1), 3, None, None), ("x", D(2012, 5, 1), 4, None, None)]
    df = spark.createDataFrame(data, "entity string, day date, tie int, grade string, rank int")
    out = wn.neighbours(df, ["entity"], ["day", "tie"], previous=["grade", "rank"], flag="earlier")
    got = {r["tie"]: r["kind"] for r in out.withColumn("kind", wn.event_type(first=~F.col("earlier"))).collect()}
    assert got == {1: "Ambiguous", 2: "Change", 3: "Change", 4: "Affirmation"}


def test_a_hot_key_is_cut_into_even_spans(spark):
    n = 9000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"),
        F.date_add(F.lit("2000-01-01"), (F.col("id") % 5).cast("int")).alias("d"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with data that is not small
    try:
        spans = wn.even_spans(df, ["k"], ["d", "id"])
        per_span = [r["n"] for r in spans.groupBy("_span").agg(F.count("*").alias("n")).collect()]
        assert max(per_span) < 2.5 * n / len(per_span) and len(per_span) >= 6
        assert spans.where("k = 'hot'").select("_span").distinct().count() > 1
        out = wn.neighbours(df, ["k"], ["d", "id"], ["id"], ["id"])
        w = Window.partitionBy("k").orderBy("d", "id")
        plain = df.select("k", "d", "id", F.lag("id").over(w), F.lead("id").over(w))
        got = out.select("k", "d", "id", "previous_id", "next_id")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
