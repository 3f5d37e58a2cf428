"""Joins, filters, positions and sources on hand-made tables."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from paneloom.functions.dates import MonthGrid
from paneloom.operators import filters as fl
from paneloom.operators import joins as jn
from paneloom.operators.positions import hash_positions, ordered_positions
from paneloom.sources import readers as rd
from paneloom.sources import writers as wr

GRID = MonthGrid(date(2010, 1, 1), date(2010, 10, 1), 3)
D = date


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_interval_join_bounds(spark):
    h = spark.createDataFrame(
        [("a", D(2010, 1, 1), D(2010, 4, 1)), ("b", D(2010, 2, 3), D(2010, 2, 20)), ("c", D(2009, 5, 5), D(2012, 1, 1)), ("d", D(2010, 11, 1), D(2011, 1, 1)), ("e", None, D(2011, 1, 1))],
        "k string, f date, t date")
    left = rows(jn.interval_join(h, "f", "t", GRID).select("k", "grid_date"))
    assert left == [("a", D(2010, 1, 1))] + [("c", D(2010, m, 1)) for m in (1, 4, 7, 10)]
    both = rows(jn.interval_join(h, "f", "t", GRID, closed="both").select("k", "grid_date"))
    assert [r for r in both if r[0] == "a"] == [("a", D(2010, 1, 1)), ("a", D(2010, 4, 1))]


def test_interval_join_equals_range_join(spark):
    rng = random.Random(1)
    data = [(i, D(2009 + rng.randrange(3), rng.randrange(1, 13), rng.randrange(1, 29)), D(2009 + rng.randrange(3), rng.randrange(1, 13), rng.randrange(1, 29))) for i in range(300)]
    h = spark.createDataFrame(data, "k int, f date, t date")
    grid = [D(2010, m, 1) for m in (1, 4, 7, 10)]
    for closed, end in (("left", lambda g, t: g < t), ("both", lambda g, t: g <= t)):
        expect = sorted((k, g) for k, f, t in data for g in grid if f <= g and end(g, t))
        assert rows(jn.interval_join(h, "f", "t", GRID, closed).select("k", "grid_date")) == expect


def test_asof_join_bounds(spark):
    left = spark.createDataFrame([("a", D(2010, 4, 1)), ("b", D(2010, 4, 1)), ("c", D(2010, 4, 1))], "k string, g date")
    events = spark.createDataFrame(
        [("a", D(2010, 4, 1), 1), ("a", D(2010, 1, 1), 2), ("b", D(2010, 3, 31), 3), ("b", D(2010, 3, 31), 4), ("c", D(2009, 12, 31), 5)],
        "k string, t date, id int")
    out = jn.asof_join(left, events, ["k"], "g", "t", ["id"], GRID, how="left")
    assert rows(out.select("k", "id")) == [("a", 2), ("b", 4), ("c", None)]


def test_interval_and_asof_plans_have_no_nested_loop(spark, folder):
    from paneloom.plans import QUERIES

    for name in ("jn7_interval_join", "jn8_asof_join", "jn13_fuzzy_best_match", "gr3_extend_over_periods"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_previous_period_sees_gaps(spark):
    p = spark.createDataFrame(
        [("a", D(2010, 1, 1), D(2009, 10, 1), 1.0), ("a", D(2010, 4, 1), D(2010, 1, 1), 3.0), ("a", D(2010, 10, 1), D(2010, 7, 1), 9.0)],
        "k string, p date, prev date, x double")
    out = jn.previous_period(p, "k", "p", "prev", ["x"])
    assert [r["x_diff"] for r in out.orderBy("p").collect()] == [None, 2.0, None]


def _jaccard(a, b, n=3):
    g = lambda s: {s[i : i + n] for i in range(max(len(s) - n + 1, 1))}
    x, y = g(a), g(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.9, 1.0])
def test_fuzzy_match_equals_brute_force(spark, threshold):
    rng = random.Random(7)
    stems = ["ACME NETWORK", "ACME NETWORKS", "GLOBEX CORP", "INITECH", "AB", "UMBRELLA HEALTH", "STARK"]
    make = lambda: "".join(c for c in rng.choice(stems) + rng.choice(["", " INC", " CO", "S", " LTD"]) if rng.random() > 0.05)
    a, b = sorted({make() for _ in range(60)}), sorted({make() for _ in range(60)})
    expect = []
    for x in a:
        scored = sorted((-_jaccard(x, y), y) for y in b if _jaccard(x, y) >= threshold)
        if scored:
            expect.append((x, scored[0][1], round(-scored[0][0], 9)))
    left = spark.createDataFrame([(x,) for x in a + a], "x string")
    right = spark.createDataFrame([(y,) for y in b], "y string")
    got = jn.fuzzy_best_match(left, right, "x", "y", threshold=threshold)
    assert rows(got.withColumn("similarity", F.round("similarity", 9))) == sorted(expect)


def test_full_join_flags_and_suffixes(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    b = spark.createDataFrame([(2, 5), (3, 6)], "k int, v int")
    s = jn.suffix_shared({"one": a, "two": b}, ["k"])
    assert s["one"].columns == ["k", "v_one"] and s["two"].columns == ["k", "v_two"]
    out = jn.flagged_full_join(s["one"], s["two"], ["k"], ("i1", "i2"))
    assert rows(out.select("k", "i1", "i2")) == [(1, 1, 0), (2, 1, 1), (3, 0, 1)]


def test_complete_cases_counts_first_null_once(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1, None), (3, 1, 1), (4, None, 1)], "id int, a int, b int")
    kept, audit = fl.complete_cases(df, ["a", "b"])
    assert rows(kept) == [(3, 1, 1)]
    assert rows(audit) == [(1, "a", 2), (2, "b", 1)]


def test_agree_treats_null_as_disagreement(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, None), (1, 2, 1)], "a int, b int, c int")
    kept, audit = fl.agree(df, ["a", "b", "c"], "v")
    assert rows(kept) == [(1,)] and audit.first()["n_disagree"] == 2


def test_drop_extreme_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 9.0), (4, None)], "id int, v double")
    assert [r[0] for r in rows(fl.drop_extreme(df, "v", "id").select("id"))] == [1, 3, 4]


def test_hash_positions_are_dense_per_group_with_hot_group(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") < 1000, "hot").otherwise((F.col("id") % 7).cast("string")))
    out = hash_positions(df, ["id"], by=["g"]).groupBy("g").agg(
        F.count("*").alias("n"), F.countDistinct("position").alias("d"), F.min("position").alias("lo"), F.max("position").alias("hi"))
    for r in out.collect():
        assert r["n"] == r["d"] == r["hi"] + 1 and r["lo"] == 0


def test_ordered_positions_and_pieces(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    got = [(r["a"], r["b"]) for r in ordered_positions(df, ["a", "b"]).orderBy("position").collect()]
    assert got == sorted(got) and len(got) == 1000
    assert wr.write_pieces(df, str(tmp_path / "p"), ["a", "b"], 7) == 1000
    sizes = {r["piece"]: r["count"] for r in spark.read.parquet(str(tmp_path / "p")).groupBy("piece").count().collect()}
    assert sizes == {i: (i + 1) * 1000 // 7 - i * 1000 // 7 for i in range(7)}


def test_more_pieces_than_rows(spark, tmp_path):
    df = spark.range(3)
    assert wr.write_pieces(df, str(tmp_path / "p"), ["id"], 5) == 3
    pieces = spark.read.parquet(str(tmp_path / "p")).select("id", "piece")
    assert rows(pieces) == [(i, next(p for p in range(5) if p * 3 // 5 <= i < (p + 1) * 3 // 5)) for i in range(3)]


def test_path_encoded_calls(spark, tmp_path):
    for sector, company, name, text in (("Tech", "Acme Co", "ACM20123", "Operator: hello, all"), ("Energy", "Oil+Gas", "OG20114", "short")):
        d = tmp_path / sector / company
        d.mkdir(parents=True)
        (d / f"{name}.csv").write_text(f',0\ndate,2012-08-01 17:00\ncontent,"{text}"\n')
        (d / "speaker names.csv").write_text("x,y\n")
    got = rows(rd.read_calls(spark, str(tmp_path)))
    assert got == [
        ("Energy", "Oil+Gas", "OG", 2011, 4, "2012-08-01 17:00", "short"),
        ("Tech", "Acme Co", "ACM", 2012, 3, "2012-08-01 17:00", "Operator: hello, all")]


def test_score_shards(spark, tmp_path):
    (tmp_path / "pos_0_3.txt").write_text("0.5\n-1\n0.25\n")
    (tmp_path / "pos_3_5.txt").write_text("1.0\n2e-1")
    assert rows(rd.read_score_shards(spark, str(tmp_path))) == [(0, 0.5), (1, -1.0), (2, 0.25), (3, 1.0), (4, 0.2)]


def test_tolerant_read_and_unnamed(spark, tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "x.csv").write_text('Unnamed: 0,k,v\n0,a,1\n1,b,oops\n2,"c\nd",\n')
    schema = StructType.fromDDL("`Unnamed: 0` int, k string, v int")
    df = rd.drop_unnamed(rd.read_tolerant(spark, str(tmp_path / "x.csv"), schema, multi_line=True))
    assert rows(df.select("k", "_bad")) == [("a", False), ("b", True), ("c\nd", False)]
    assert "Unnamed: 0" not in df.columns


def test_csv_round_trip_keeps_blanks_and_newlines(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a "quoted", b\nc '), (2, "x")], "k int, t string")
    wr.write_csv(df, str(tmp_path / "c"))
    assert rows(rd.read_csv(spark, str(tmp_path / "c"), df.schema, multi_line=True)) == rows(df)


def test_metric_log_last_write_wins(spark, tmp_path):
    path = str(tmp_path / "log")
    for seq, (name, value) in enumerate([("acc", 0.1), ("n", 5), ("acc", 0.2)]):
        wr.log_metric(spark, path, name, value, seq)
    got = {r["name"]: (r["value"], r["command"]) for r in wr.latest_metrics(spark.read.parquet(path)).collect()}
    assert got == {"acc": ("0.2", "renewcommand"), "n": ("5", "newcommand")}


def test_last_json_label_wins(spark):
    text = '{"data": {"bs": [{"label": "X", "value": 1}, {"label": "Y", "value": 2}, {"label": "X", "value": 3}], "ic": []}}'
    df = spark.createDataFrame([(text,)], "t string").withColumn("d", rd.json_field(F.col("t"), f"data {rd.ENTRY_SCHEMA}", "data"))
    assert df.select(rd.labelled_value(F.col("d.bs"), "X"), rd.labelled_value(F.col("d.ic"), "X")).first() == (3.0, None)


def test_a_csv_file_is_read_in_splits(spark, tmp_path):
    path = str(tmp_path / "one.csv")
    with open(path, "w") as f:
        f.write("a,b\n" + "".join(f"{i},text {i}\n" for i in range(60_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        df = rd.read_csv(spark, path, "a long, b string")
        assert df.rdd.getNumPartitions() > 4 and df.selectExpr("sum(a)").first()[0] == 60_000 * 59_999 // 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_positions_with_longer_prefixes(spark, monkeypatch):
    from paneloom.operators import positions

    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).alias("g"))
    want = {r["id"]: r["position"] for r in positions.hash_positions(df, ["id"], by=["g"]).collect()}
    monkeypatch.setattr(positions, "BUCKET_ROWS", 1)
    got = {r["id"]: r["position"] for r in positions.hash_positions(df, ["id"], by=["g"]).collect()}
    assert got == want and sorted(v for k, v in got.items() if k % 3 == 0) == list(range(1667))
