"""Keys of several grams in the fuzzy join."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from paneloom.operators import joins as jn
from paneloom.plans.standins import SQL_FIRMS, firms


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _grams(s):
    return {s[i: i + 3] for i in range(max(len(s) - 2, 1))}


def _best(a, b, threshold, not_equal):
    out = []
    for x in sorted(set(a)):
        scored = sorted((-len(_grams(x) & _grams(y)) / len(_grams(x) | _grams(y)), y) for y in set(b) if not (not_equal and x == y))
        if scored and -scored[0][0] >= threshold:
            out.append((x, scored[0][1], round(-scored[0][0], 9)))
    return out


@pytest.mark.parametrize("threshold, hot, not_equal", [(0.7, 2, False), (0.7, 2, True), (0.15, 2, False), (0.4, 5, True), (1.0, 2, False)])
def test_fuzzy_match_by_longer_keys(spark, threshold, hot, not_equal):
    rng = random.Random(3)
    parts = ["thor", "tion", "the", "of", "ß", "en", "🙂x", "ing", "a"]
    names = [" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4))) for _ in range(90)]
    names += ["", "a", "ab", "abc", "abcd", "aaaa", "aaaaa", "x" * 40]
    other = [n[:4] + n[5:] for n in names] + names[::3]
    left, right = spark.createDataFrame([(n,) for n in [*names, None]], "x string"), spark.createDataFrame([(n,) for n in [*other, None]], "y string")
    got = jn.fuzzy_best_match(left, right, "x", "y", threshold=threshold, hot=hot, not_equal=not_equal)
    assert rows(got.withColumn("similarity", F.round("similarity", 9))) == sorted(_best(names, other, threshold, not_equal), key=str)


def test_names_with_a_frequent_key_meet_by_longer_keys(spark):
    # The marked names share a gram that is rarer than those of their letters and hardly differ in size, so that a gram and a size keep them together.
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcd") for _ in range(14))
    marked = [f"{w[:7]}qzx{w[7:]}" for w in (word() for _ in range(400))]
    df = spark.createDataFrame([(n,) for n in marked + [word() for _ in range(3000)]], "name string")
    frequency = jn.gram_frequency(jn.name_grams(df, "name", 3))
    sets = jn.gram_sets(jn.name_grams(df.where("name like '%qzx%'"), "name", 3), 0.7, frequency).cache()
    first = jn.first_keys(sets)
    largest = lambda g: g.groupBy("gram", "cell").count().agg(F.max("count")).first()[0]
    assert largest(jn.gram_groups(first, first, 0.7, 50)[1]) > 100
    assert largest(jn.gram_groups(*jn.refined(first, first, 50), 0.7, 50)[1]) < 50


def test_firms_as_in_sql(spark):
    import duckdb

    texts = ["a b c d e f g h i j k l", " \t\n a\fb \r c  ", "", None, "one two", "Fuß ßß ß a\x0bb ß\xa0c d e f", "x" * 100_000 + " y z\nw", "  " * 5000 + "p q r"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0])]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    want = con.execute(f"with {SQL_FIRMS} select doc_id, k, name from firms").fetchall()
    assert rows(firms(SimpleNamespace(documents=spark.createDataFrame(docs, "doc_id long, text string")))) == sorted(want, key=str)
