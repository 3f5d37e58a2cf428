"""Joins of vectors and names, file readers, moments, certificates and saved models on hand-made tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from paneloom.operators import joins as jn
from paneloom.operators import learning as ml
from paneloom.operators import metrics as mt
from paneloom.operators import moments as mo
from paneloom.operators import vectors as vc
from paneloom.operators.quantiles import quantiles
from paneloom.sources import readers as rd
from paneloom.sources import writers as wr


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def _clustered(spark, clusters=12, each=25, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    v = np.repeat(centres, each, axis=0) + rng.normal(size=(clusters * each, dims)) * 0.05
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    return v, spark.createDataFrame([*data, (9998, None), (9999, [0.0] * dims)], "id long, v array<double>")


@pytest.mark.parametrize("block_rows", [10, 400])
def test_cosine_join_prunes_blocks_and_loses_nothing(spark, monkeypatch, block_rows):
    v, df = _clustered(spark)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = {(i, j): float(u[i] @ u[j]) for i, j in itertools.combinations(range(len(u)), 2)}
    got = vc.cosine_join(df, "id", "v", at_least=0.95, block_rows=block_rows)
    assert {(r["src"], r["dst"]) for r in got.collect()} == {k for k, s in sims.items() if s >= 0.95}
    for pages in (1024, 3):
        monkeypatch.setattr(vc, "PAGE", pages)
        got = vc.cosine_join(df, "id", "v", quantile=0.9, block_rows=block_rows)
        cut = np.quantile(list(sims.values()), 0.9)
        assert {(r["src"], r["dst"]) for r in got.collect()} == {k for k, s in sims.items() if s >= cut}
    units = vc.unit_vectors(df, "id", "v")
    blocks, n, vectors = vc.block_table(units, vc._hash_sample(units, "id", "v", vc.PIVOTS), 10)
    assert (blocks.count(), vectors) == (n, len(v))
    assert vc.block_pairs(blocks, n, 0.95).count() < 0.5 * n * (n + 1) / 2
    assert vc.block_pairs(blocks, n, -1.0).count() == n * (n + 1) / 2


def test_cosine_join_lowers_a_threshold_that_was_too_high(spark, monkeypatch):
    v, df = _clustered(spark, clusters=6, each=20)
    monkeypatch.setattr(vc, "SAMPLE", 12)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = {(i, j): float(u[i] @ u[j]) for i, j in itertools.combinations(range(len(u)), 2)}
    cut = np.quantile(list(sims.values()), 0.7)
    got = vc.cosine_join(df, "id", "v", quantile=0.7, block_rows=15)
    assert {(r["src"], r["dst"]) for r in got.collect()} == {k for k, s in sims.items() if s >= cut}


def test_quantile_of_cosines_writes_no_pairs(spark, monkeypatch):
    v, df = _clustered(spark, clusters=6, each=20)
    twice = df.unionByName(df.selectExpr("id + 20000 as id", "v"))
    written, stored = [], vc.stored
    monkeypatch.setattr(vc, "stored", lambda rows, name="table": written.append(name) or stored(rows, name))
    monkeypatch.setattr(vc, "TILES", 3, raising=False)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    ids = [*range(len(u)), *range(20000, 20000 + len(u))]
    sims = {(i, j): float(u[i % 20000] @ u[j % 20000]) for i, j in itertools.combinations(ids, 2)}
    cut = np.quantile(list(sims.values()), 0.9)
    got = {(r["src"], r["dst"]) for r in vc.cosine_join(twice, "id", "v", quantile=0.9, block_rows=15).collect()}
    assert {k for k, x in sims.items() if x >= cut + 1e-12} <= got <= {k for k, x in sims.items() if x >= cut - 1e-12}
    assert written == ["blocks"]


def test_cosine_join_of_nothing_and_of_equal_vectors(spark):
    empty = spark.createDataFrame([], "id string, v array<float>")
    assert vc.cosine_join(empty, "id", "v", 0.5).count() == 0
    same = spark.createDataFrame([(f"k{i}", [1.0, 2.0]) for i in range(30)], "id string, v array<float>")
    assert vc.cosine_join(same, "id", "v", at_least=1.0 - 1e-9, block_rows=4).count() == 435
    one = spark.createDataFrame([("a", [1.0, 0.0])], "id string, v array<float>")
    assert vc.cosine_join(one, "id", "v", 0.5).count() == 0


@pytest.mark.parametrize("block_rows", [16, 4000])
def test_nearest_members_are_exact(spark, block_rows):
    v, _ = _clustered(spark, clusters=5, each=30, dims=3)
    v = np.round(v, 1)  # ties
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "p long, v array<double>")
    got = {(r["seed"], r["rank"]): r["other"] for r in vc.nearest_members(df.where("p % 3 = 0"), df, "p", "v", 4, block_rows).collect()}
    d = ((v[:, None, :] - v[None, :, :]) ** 2)
    dist = d[..., 0] + d[..., 1] + d[..., 2]
    for i in range(0, len(v), 3):
        want = sorted((j for j in range(len(v)) if j != i), key=lambda j: (dist[i, j], j))[:4]
        assert [got[i, r] for r in range(4)] == want


def test_equal_members_take_the_smallest_positions(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(600)] + [(1000, [5.0, 5.0])], "p long, v array<double>")
    got = vc.nearest_members(df, df, "p", "v", 3, 100).collect()
    assert len(got) == 601 * 3
    assert {r["other"] for r in got if r["seed"] == 0} == {1, 2, 3} and {r["other"] for r in got if r["seed"] == 1} == {0, 2, 3}
    assert {r["other"] for r in got if r["seed"] == 1000} == {0, 1, 2}


def test_oversampling_equal_members(spark):
    df = spark.createDataFrame([(i, "a", [2.0, 3.0]) for i in range(40)] + [(99, "b", [0.0, 0.0])], "id long, y string, f array<double>")
    out = ml.smote(df, "y", "id", "f", {"a": 55}, k=5, seed=2, block_rows=8)
    assert out.where("id is null").count() == 15 and {tuple(r["f"]) for r in out.where("id is null").collect()} == {(2.0, 3.0)}


# ---------------------------------------------------------------- files


def test_score_shards_of_any_length_read_in_splits(spark, tmp_path):
    rng = random.Random(2)
    want, at = {}, 0
    for n in (1, 700, 3, 2500, 40):
        values = [round(rng.uniform(-1, 1), 6) for _ in range(n)]
        (tmp_path / f"score_{at}_{at + n}.txt").write_text("\n".join(map(str, values)) + "\n\n")
        want |= {at + i: v for i, v in enumerate(values)}
        at += n
    (tmp_path / "a_0_2.txt").write_text("x\n7")  # overlaps, first by name, and one line is no number
    want |= {0: None, 1: 7.0}
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "1000")
        spark.conf.set(keys[1], "100")
        lines = rd.numbered_lines(spark, str(tmp_path))
        got = {r["position"]: r["score"] for r in rd.read_score_shards(spark, str(tmp_path)).collect()}
        assert lines.where("file = 'score_704_3204.txt'").count() == 2500 and lines.agg(F.max("line")).first()[0] == 2499
    finally:
        for k, b in zip(keys, before):
            spark.conf.set(k, b)
    assert got == want


def test_named_texts_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a b/one_0_2.txt", 1, "y"), ("a b/one_0_2.txt", 0, "x"), ("é=1/+.txt", 0, "z")], "name string, at int, v string")
    path = str(tmp_path / "tree")
    wr.write_named_texts(df, path, "name", "v", ["at"])
    assert (tmp_path / "tree" / "a b" / "one_0_2.txt").read_text() == "x\ny\n"
    assert (tmp_path / "tree" / "é=1" / "+.txt").read_text() == "z\n"


def test_file_tree_with_files_that_cannot_be_loaded(spark, tmp_path):
    def put(name, data):
        (tmp_path / "Tech" / "Acme").mkdir(parents=True, exist_ok=True)
        (tmp_path / "Tech" / "Acme" / name).write_bytes(data)

    good = b',0\ndate,2012-08-01 17:00\ncontent,"Operator: hi\nall"\n'
    put("ACM20121.csv", good)
    put("ACM20122.csv", b",0\ndate,2012-08-01 17:00\n")  # cut
    put("ACM20124.csv", good.replace(b"hi", b"\xff\xfe"))  # no UTF-8
    put("ACM20131.csv", good + b"x" * 5000)  # too large
    put("speaker names.csv", b"a,b\n")
    found = rd.read_call_files(spark, str(tmp_path), most_bytes=1000).collect()
    assert {(r["year"], r["quarter"]): r["loaded"] for r in found} == {(2012, 1): True, (2012, 2): False, (2012, 4): False, (2013, 1): False}
    assert all((r["sector"], r["company"], r["symbol"]) == ("Tech", "Acme", "ACM") for r in found)
    assert [r["transcript"] for r in rd.read_calls(spark, str(tmp_path)).where("quarter = 1 and year = 2012").collect()] == ["Operator: hi\nall"]


# ---------------------------------------------------------------- names


@pytest.mark.parametrize("hot", [2, 1000])
def test_fuzzy_match_with_hot_grams(spark, hot):
    rng = random.Random(4)
    stems = ["THE NORTHERN " + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 12))) for _ in range(80)]
    a, b = sorted(set(stems)), sorted({s.replace("E", rng.choice(["", "EE", "E"])) for s in stems})
    g = lambda s: {s[i: i + 3] for i in range(max(len(s) - 2, 1))}
    want = []
    for x in a:
        scored = sorted((-len(g(x) & g(y)) / len(g(x) | g(y)), y) for y in b)
        if -scored[0][0] >= 0.6:
            want.append((x, scored[0][1], round(-scored[0][0], 9)))
    left, right = (spark.createDataFrame([(x,) for x in s], "name string") for s in (a, b))
    got = jn.fuzzy_best_match(left, right.withColumnRenamed("name", "other"), "name", "other", threshold=0.6, hot=hot)
    assert rows(got.withColumn("similarity", F.round("similarity", 9))) == sorted(want)


def test_hot_grams_meet_by_size(spark):
    rng = random.Random(1)
    names = spark.createDataFrame([("HOT" + "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(i)),) for i in range(1, 25) for j in range(10)], "name string")
    ranked = jn.ranked_grams(names, "name", 0.05, 3)
    largest = lambda hot: jn.gram_groups(ranked, ranked, 0.05, hot)[1].groupBy("gram", "cell").count().agg(F.max("count")).first()[0]
    assert largest(20) <= 10 and largest(10**9) == 240


# ---------------------------------------------------------------- moments, quantiles, fits


def test_moments_and_components(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 4)) @ rng.normal(size=(4, 4)) + 1e6
    df = spark.createDataFrame([([float(v) for v in r],) for r in x] + [(None,), ([1.0, None, 2.0, 3.0],)], "v array<double>").repartition(5)
    m = mo.moments(df, F.col("v"))
    assert m.n == 500
    np.testing.assert_allclose(m.mean, x.mean(0), rtol=1e-12)
    np.testing.assert_allclose(m.covariance, np.cov(x.T), rtol=1e-8, atol=1e-8)
    values, vectors = mo.jacobi(m.covariance)
    np.testing.assert_allclose(values, np.linalg.eigvalsh(m.covariance)[::-1], rtol=1e-9)
    np.testing.assert_allclose(vectors @ np.diag(values) @ vectors.T, m.covariance, atol=1e-8)
    shares = mo.explained_variance(df, "v", 4)
    assert abs(sum(shares) - 1) < 1e-12 and shares == sorted(shares, reverse=True)
    assert mo.explained_variance(df.where("v is null"), "v", 2) == []


@pytest.mark.parametrize("small", [50, 500_000])
def test_quantiles_in_two_passes(spark, small):
    rng = np.random.default_rng(6)
    n = 30_000
    a, b = rng.normal(size=n), np.where(rng.random(n) < 0.4, np.inf, np.round(rng.normal(size=n), 1))
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)], "a double, b double, c double")
    levels = {"a": [0.0, 0.001, 0.5, 0.51, 1.0], "b": [0.1, 0.5, 0.9], "c": [0.5]}
    got = quantiles(df, levels, small=small)
    np.testing.assert_allclose(got["a"], np.quantile(a, levels["a"]), rtol=1e-12)
    s = np.sort(b)
    assert got["b"][2] == np.inf and got["c"] == [None]
    for p, v in zip(levels["b"][:2], got["b"]):
        at = (n - 1) * p
        assert s[int(at)] <= v <= s[int(at) + 1]


def _toy(spark, n=300):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 3))
    y = (x @ np.array([[1.5, 0.0, -1.0], [0.2, 0.0, 0.1], [0.0, 0.0, 0.0]]).T + rng.normal(size=(n, 3))).argmax(1)
    return spark.createDataFrame([(Vectors.dense(r), float(c)) for r, c in zip(x, y)], ["features", "label"])


@pytest.mark.parametrize("c, mix", [(None, 0.0), (1.0, 0.0), (0.05, 1.0), (0.1, 0.5)])
def test_certificate_of_a_fit(spark, c, mix):
    df = _toy(spark)
    model = ml.elastic_net(300, c=c, l1_ratio=mix).fit(df)
    reg = 0.0 if c is None else 1 / (c * 300)
    assert ml.optimality(model, df, reg, mix).max() < 1e-4
    if c:
        assert ml.optimality(ml.elastic_net(300, c=c, l1_ratio=mix, max_iter=1).fit(df), df, reg, mix).max() > 1e-4


def test_saved_models_are_loaded_not_fitted(spark, tmp_path, monkeypatch):
    df, fits = _toy(spark, 60), []
    real = LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, *a, **k: fits.append(1) or real(self, *a, **k))
    key = df.select("label", F.monotonically_increasing_id().alias("id"))
    one, two = (ml.fitted(ml.elastic_net(60), df, str(tmp_path), {"c": 1.0}, key=key) for _ in range(2))
    assert len(fits) == 1 and np.array_equal(one.coefficientMatrix.toArray(), two.coefficientMatrix.toArray())
    ml.fitted(ml.elastic_net(60, c=2.0), df, str(tmp_path), {"c": 2.0}, key=key)
    ml.fitted(ml.elastic_net(60), df.where("label > 0"), str(tmp_path), {"c": 1.0}, key=key.where("label > 0"))
    assert len(fits) == 3
    assert ml.fingerprint(key, {}) == ml.fingerprint(key.orderBy(F.desc("id")), {}) != ml.fingerprint(key.limit(59), {})


def test_agreement_from_patterns(spark):
    rng = random.Random(9)
    data = [(m, k, "x", rng.choice("xy")) for m in "abcd" for k in range(80) if rng.random() < 0.9]
    data += [("e", k, "x", p) for m, k, _, p in data if m == "a"]
    p = spark.createDataFrame(data, "model string, k int, truth string, prediction string")
    got = {tuple(r)[:2]: tuple(r)[2:] for r in mt.agreement_of_all(p, ["k"], list("abcde")).collect()}
    right = {(m, k): t == q for m, k, t, q in data}
    for x, y in itertools.combinations("abcde", 2):
        both = [(right[x, k], right[y, k]) for k in range(80) if (x, k) in right and (y, k) in right]
        assert got[x, y] == tuple(both.count(c) for c in ((True, True), (True, False), (False, True), (False, False)))
    block = {tuple(r)[:2]: r for r in mt.p_value_block(mt.agreement_of_all(p, ["k"], list("abcde"))).collect()}
    assert block["a", "e"]["p_exact"] == "-" and block["a", "e"]["p_plain"] == "-"
    assert float(block["a", "b"]["p_exact"]) <= 1


def test_audited_fold_counts_losses_and_repeats(spark):
    base = spark.createDataFrame([(i, i % 4) for i in range(10)], "k int, g int")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "g int, name string")
    two = spark.createDataFrame([(0, 1.0), (1, 1.0), (1, 2.0), (5, 3.0), (77, 0.0)], "k int, v double")
    full, audit = jn.audited_fold(base, [("names", one, ["g"]), ("values", two, ["k"])])
    assert rows(full.select("k", "name", "v")) == [(0, "a", 1.0), (1, "b", 1.0), (1, "b", 2.0), (5, "b", 3.0)]
    assert [tuple(r) for r in audit.orderBy("step").collect()] == [(1, "names", 11, 9, 2, 0), (2, "values", 9, 4, 5, 1)]
