"""Bundled edges, edges turned once, names compared where they meet."""

import re
from datetime import date

from pyspark.sql import functions as F

from paneloom.operators import graph as gr, joins as jn

DAYS = [date(2000 + i, 1, 1) for i in range(70)]  # more than a word of marks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _network(spark):
    links = [(a, b, DAYS[(7 * a + b) % 70]) for a in range(1, 9) for b in range(1, 9) if (a * b) % 5 != 2]
    nodes = [(k, d, f"{k}@{d}", f"c{k % 3}", "train" if (k + i) % 4 else "test") for k in range(2, 9) for i, d in enumerate(DAYS) if (k + i) % 3]
    nodes += [(None, DAYS[0], "x", "c1", "train"), (3, None, "y", "c1", "train"), nodes[0]]
    e = spark.createDataFrame(links + [(None, 2, DAYS[1]), (2, None, None)], "src long, dst long, period date")
    return e, spark.createDataFrame(nodes, "entity long, period date, node string, label string, split string")


def test_bundled_edges_equal_flat_ones(spark):
    e, n = _network(spark)
    flat = gr.resolve_edges(gr.extend_over_periods(e, "period"), n.distinct(), "entity", "period")
    bundle = gr.extend_over_periods(e, "period", bundled=True)
    assert bundle.links.count() == e.select("src", "dst").distinct().count()
    assert rows(gr.resolve_edges(bundle, n.distinct(), "entity", "period")) == rows(flat)
    kept, pruned = gr.prune(n, flat, "label", "split")
    kept2, pruned2 = gr.prune(n, gr.in_both(bundle, n, "entity", "period"), "label", "split")
    assert rows(kept2.select(n.columns)) == rows(kept.select(n.columns))
    assert rows(gr.resolve_edges(pruned2, n.distinct(), "entity", "period")) == rows(pruned)
    assert rows(gr.degree_stats(pruned2).select("nodes", "directed_edges", "mean_degree")) == rows(gr.degree_stats(pruned))


def test_bundle_without_periods(spark):
    e, n = _network(spark)
    none = gr.in_both(gr.extend_over_periods(e.where("false"), "period", bundled=True), n, "entity", "period")
    assert none.links.count() == 0 and rows(gr.degree_stats(none).select("nodes", "directed_edges", "mean_degree")) == [(0, None, None)]


def test_edges_are_turned_after_the_shuffle(spark):
    e = spark.createDataFrame([(1, 2, 3), (2, 1, 4), (3, 3, 5), (None, 1, 6), (None, None, 7)], "src long, dst long, weight long")
    both = gr.symmetrise(e)
    assert rows(both) == rows(spark.createDataFrame([(1, 2), (2, 1), (3, 3), (None, 1), (1, None), (None, None)], "src long, dst long"))
    top = gr.top_neighbours(e, 5)
    assert {r["node"]: r["neighbours"] for r in top.collect()}[1] == ["2", None]
    for df in (both, top):
        assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_name_pairs_are_not_shuffled_as_candidates(spark):
    names = spark.createDataFrame([(f"NORTHERN {w} TRADE",) for w in ("LIGHT", "LIGHTS", "NIGHT", "SIGHT", "OIL")], "x string")
    out = jn.fuzzy_best_match(names, names.withColumnRenamed("x", "y"), "x", "y", threshold=0.5, not_equal=True)
    assert not re.search(r"Aggregate \[[^\]]*_other", out._jdf.queryExecution().optimizedPlan().toString())
    got = {r["x"]: r["y"] for r in out.select("x", "y").collect()}
    assert got["NORTHERN LIGHT TRADE"] == "NORTHERN LIGHTS TRADE" and len(got) >= 4
    assert out.where(F.col("x") == F.col("y")).count() == 0
