"""Graph operators, over-sampling, splits and metrics on hand-made tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.operators import graph as gr
from paneloom.operators import learning as ml
from paneloom.operators import metrics as mt
from paneloom.operators import moments


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_undirected_edges(spark):
    m = spark.createDataFrame([("a", "b", 2), ("b", "a", 3), ("c", "c", 1)], "x string, y string, n int")
    assert rows(gr.undirected_edges(m, "x", "y", weight=F.col("n"))) == [("a", "b", 5)]
    assert rows(gr.undirected_edges(m, "x", "y")) == [("a", "b", 2)]


def test_extension_and_resolution(spark):
    e = spark.createDataFrame([("a", "b", 1), ("c", "d", 2)], "src string, dst string, p int")
    extended = gr.extend_over_periods(e, "p")
    assert rows(extended) == [("a", "b", 1), ("a", "b", 2), ("c", "d", 1), ("c", "d", 2)]
    n = spark.createDataFrame([("a", 1, "a:1"), ("b", 1, "b:1"), ("b", 2, "b:2"), ("c", 2, "c:2")], "k string, p int, node string")
    assert rows(gr.resolve_edges(extended, n, "k", "p")) == [("a:1", "b:1")]


def test_prune_one_round(spark):
    nodes = spark.createDataFrame(
        [("a", "X", "train"), ("b", "X", "train"), ("c", "Y", "train"), ("d", "Y", "test"), ("e", "X", "test"), ("lonely", "X", "train")],
        "node string, label string, split string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("e", "d")], "src string, dst string")
    n, e = gr.prune(nodes, edges, "label", "split")
    assert rows(e) == [("a", "b")] and [r[0] for r in rows(n.select("node"))] == ["a", "b"]


def test_codes_are_dense(spark):
    n = spark.createDataFrame([(f"n{i % 50}",) for i in range(200)], "node string")
    assert sorted(r["node_int"] for r in gr.encode_nodes(n).collect()) == list(range(50))


def test_top_neighbours(spark):
    e = spark.createDataFrame([("a", "b", 1), ("a", "c", 5), ("a", "d", 3), ("b", "c", 2)], "src string, dst string, weight int")
    got = {r["node"]: r["neighbours"] for r in gr.top_neighbours(e, 2).collect()}
    assert got == {"a": ["c", "d"], "b": ["c", "a"], "c": ["a", "b"], "d": ["a"]}


@pytest.mark.parametrize("block_rows", [7, 1000])
@pytest.mark.parametrize("quantile", [0.5, 0.98])
def test_similarity_edges_equal_brute_force(spark, block_rows, quantile):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 8))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    pairs = {(i, j): float(u[i] @ u[j]) for i, j in itertools.combinations(range(40), 2)}
    cut = np.quantile(list(pairs.values()), quantile)
    expect = sorted(k for k, s in pairs.items() if s >= cut)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>")
    got = gr.similarity_edges(df, "id", "v", quantile, block_rows=block_rows)
    assert [r[:2] for r in rows(got)] == expect
    fixed = gr.similarity_edges(df, "id", "v", at_least=0.4, block_rows=block_rows)
    assert [r[:2] for r in rows(fixed)] == sorted(k for k, s in pairs.items() if s >= 0.4)


def test_neighbour_aggregate(spark):
    n = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 9.0)], "node string, x double")
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("b", "a")], "src string, dst string")
    got = {r["node"]: (r["x_max1"], r["x_max2"]) for r in gr.neighbour_aggregate(n, e, ["x"], hops=2).collect()}
    assert got == {"a": (5.0, 9.0), "b": (9.0, 5.0), "c": (None, None)}


@pytest.mark.parametrize("block_rows", [6, 1000])
def test_smote_lies_between_near_neighbours(spark, block_rows):
    rng = np.random.default_rng(4)
    points = {i: rng.normal(size=3) for i in range(30)}
    df = spark.createDataFrame([(i, "small" if i < 20 else "big", [float(x) for x in p]) for i, p in points.items()], "id long, y string, f array<double>")
    out = ml.smote(df, "y", "id", "f", {"small": 50}, k=3, seed=1, block_rows=block_rows)
    new = [np.array(r["f"]) for r in out.where("id is null").collect()]
    assert len(new) == 30 and out.where("id is not null").count() == 30
    small = [points[i] for i in range(20)]
    for z in new:
        fits = False
        for p in small:
            near = sorted((q for q in small if q is not p), key=lambda q: np.linalg.norm(q - p))[:3]
            for q in near:
                d = q - p
                t = float(np.dot(z - p, d) / np.dot(d, d))
                fits |= -1e-9 <= t <= 1 + 1e-9 and np.linalg.norm(p + t * d - z) < 1e-9
        assert fits


def test_exact_holdout_sizes(spark):
    df = spark.range(103).withColumn("y", F.when(F.col("id") < 70, "hot").otherwise("cold"))
    got = rows(ml.exact_holdout(df, "y", ["id"]).groupBy("y", "split").count())
    assert got == [("cold", "train", 27), ("cold", "validation", 6), ("hot", "train", 56), ("hot", "validation", 14)]


def test_group_wise_split_keeps_entities_together(spark):
    df = spark.range(500).withColumn("e", F.col("id") % 40).withColumn("s", ml.split_flag(["e"]))
    assert df.groupBy("e").agg(F.countDistinct("s").alias("n")).where("n > 1").count() == 0


def test_roles():
    reg = [ml.Variable("y", "categorical", {"m": "Y"}), ml.Variable("a", "numeric", {"m": "X"}), ml.Variable("p", "numeric", {"m": "X (Previous)"}), ml.Variable("c", "categorical", {"m": "X"})]
    assert ml.select_roles(reg, "m") == (["a"], ["c"], "y")
    assert ml.select_roles(reg, "m", include_previous=True) == (["a", "p"], ["c"], "y")
    with pytest.raises(ValueError):
        ml.select_roles(reg, "other")


def test_metrics_edge_cases(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "z"), ("c", "a")], "truth string, prediction string")
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in mt.class_report(p).collect()}
    assert got == {"a": (0.5, 0.5, 0.5, 2), "b": (0.5, 0.5, 0.5, 2), "c": (0.0, 0.0, 0.0, 1), "z": (0.0, 0.0, 0.0, 0)}
    s = mt.summary(p).first()
    assert s["accuracy"] == 0.4 and s["majority_share"] == 0.4 and s["weighted_f1"] == pytest.approx(0.4)
    cm = {r["truth"]: r.asDict() for r in mt.confusion(p, ["a", "b", "c", "z"]).collect()}
    assert cm["z"] == {"truth": "z", "a": 0, "b": 0, "c": 0, "z": 0, "other": 0} and cm["b"]["z"] == 1


def test_mcnemar_values():
    none = mt.mcnemar_p_values(0, 0)
    assert set(none.values()) == {None}
    p = mt.mcnemar_p_values(10, 2)
    assert p["plain"] == pytest.approx(math.erfc(math.sqrt(64 / 12 / 2)))
    assert p["corrected"] == pytest.approx(math.erfc(math.sqrt(49 / 12 / 2)))
    assert p["exact"] == pytest.approx(2 * sum(math.comb(12, k) for k in range(3)) / 2**12)
    assert mt.mcnemar_p_values(5, 5)["exact"] == 1.0


def test_model_pairs_table(spark):
    data = [(m, i, "x" if i % 2 else "y", "x" if (i + s) % 3 else "y") for m, s in (("p", 0), ("q", 1)) for i in range(30)]
    long = spark.createDataFrame(data, "model string, id int, truth string, prediction string")
    t = mt.agreement_table(mt.model_pairs(long, ["id"], [("p", "q")]), ["model_1", "model_2"]).first()
    ok = {(m, i): truth == pred for m, i, truth, pred in data}
    cells = [sum(ok["p", i] is a and ok["q", i] is b for i in range(30)) for a, b in ((True, True), (True, False), (False, True), (False, False))]
    assert [t["both_right"], t["only_1_right"], t["only_2_right"], t["both_wrong"]] == cells


def test_prior_baseline_uses_training_classes_only(spark):
    train = spark.createDataFrame([("a",)] * 9 + [("b",)], "y string")
    test = spark.range(2000).withColumn("y", F.lit("c"))
    got = dict(ml.prior_baseline(train, test, "y", ["id"]).groupBy("prediction").count().collect())
    assert set(got) == {"a", "b"} and abs(got["a"] / 2000 - 0.9) < 0.03


def test_first_component_sign_and_scale(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    data = [(i, float(v), float(2 * v + rng.normal() * 0.1)) for i, v in enumerate(x)] + [(999, None, 1.0)]
    df = spark.createDataFrame(data, "id int, a double, b double")
    got = {r["id"]: r["pc"] for r in moments.first_component(df, ["a", "b"], "pc").collect()}
    assert got[999] is None
    z = np.array([[a, b] for _, a, b in data[:-1]])
    z = (z - z.mean(0)) / z.std(0)
    w = np.linalg.svd(z, full_matrices=False)[2][0]
    expect = z @ (w if w[np.argmax(abs(w))] > 0 else -w)
    np.testing.assert_allclose([got[i] for i in range(200)], expect, atol=1e-8)


def test_confusion_and_crosstab_lose_nothing(spark):
    from paneloom.operators import aggregates as ag

    p = spark.createDataFrame([("m", "a", "a"), ("m", "a", "x"), ("n", None, "b"), ("n", "c", "a")], "model string, truth string, prediction string")
    listed = mt.confusion(p, ["a", "b"]).collect()
    assert sum(r["a"] + r["b"] + r["other"] for r in listed) == 4
    found = {(r["model"], r["truth"]): (r["a"], r["b"], r["c"], r["x"]) for r in mt.confusion(p, by=["model"]).collect()}
    assert found["m", "a"] == (1, 0, 0, 1) and found["n", "c"] == (1, 0, 0, 0) and len(found) == 8
    table = {r["model"]: r.asDict() for r in ag.crosstab(p, "model", "prediction", ["a"]).collect()}
    assert table == {"m": {"model": "m", "a": 1, "other": 1}, "n": {"model": "n", "a": 1, "other": 1}}
    assert set(ag.crosstab(p, "model", "prediction").columns) == {"model", "a", "b", "x"}


def test_unseen_categories_are_zeros(spark):
    rows = spark.createDataFrame([(1.0, "a", "y"), (2.0, "b", "n"), (3.0, "c", "y")], "x double, c string, t string")
    matrix = ml.design_matrix(["x"], ["c"], "t").fit(rows)
    new = spark.createDataFrame([(2.0, "zzz", "y"), (2.0, "b", "n")], "x double, c string, t string")
    unseen, known = [list(r["features"].toArray()) for r in matrix.transform(new).collect()]
    assert unseen == [0.0, 0.0, 0.0, 0.0] and known == [0.0, 0.0, 1.0, 0.0]


def test_vectors_without_direction_have_no_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0])], "id int, v array<double>")
    assert [(r["src"], r["dst"]) for r in gr.similarity_edges(v, "id", "v", quantile=None, at_least=0.9).collect()] == [(1, 2)]


def test_exact_p_value_of_many_disagreements():
    many = mt.mcnemar_p_values(2_000_000, 2_001_000)
    assert many["exact"] == pytest.approx(many["corrected"], rel=1e-3)
    assert mt.mcnemar_p_values(10**9, 10**9 - 10)["exact"] <= 1.0
