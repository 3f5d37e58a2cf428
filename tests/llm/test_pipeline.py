"""The pipeline's stages against plain code, and on odd tables."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, _rows


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def _ids(frame):
    return Counter(r.doc_id for r in frame.select("doc_id").collect())


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "packing"]


def test_language_keeps_clean_documents(spark, folder, docs):
    odd = [(10**6, None), (10**6 + 1, "12345 67890"), (10**6 + 2, ""), (10**6 + 3, "\U0001f600 " * 50)]
    more = docs.unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema))
    out = corpus_pipeline.language(spark, more, folder)
    assert out.columns == docs.columns
    assert _ids(out) == _ids(docs)


def test_near_duplicates_leave_one_of_each_group(spark, folder, docs):
    rng = random.Random(2)
    base = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    close = list(base)
    close[100] = "other"
    more = docs.unionByName(spark.createDataFrame(
        [(10**6, " ".join(base), "en", "s", 1), (10**6 + 1, " ".join(base).upper(), "en", "s", 1), (10**6 + 2, " ".join(close), "en", "s", 1),
         (None, "without id", "en", "s", 1)], docs.schema))
    out = corpus_pipeline.near_duplicates(spark, more, folder)
    want = brute.classes([(r.doc_id, r.text) for r in more.collect() if r.doc_id is not None], 5, 80)
    assert _ids(out) == Counter([None, *(i for i, (_, c) in want.items() if i == c)])
    assert out.columns == docs.columns


def test_mixing_and_packing_carry_copies(spark, folder, docs):
    taken = corpus_pipeline.mixing(spark, docs, folder)
    assert taken.columns == docs.columns
    copies = _ids(taken)
    assert set(copies) <= set(_ids(docs)) and max(copies.values()) <= 3
    packed = corpus_pipeline.packing(spark, taken, folder).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies


def test_secrets_are_masked(spark, folder, docs):
    from paneloom.llm import op5_secrets

    out = corpus_pipeline.secrets(spark, docs, folder)
    assert _ids(out) == _ids(docs) and out.columns == docs.columns
    left = op5_secrets.scan(out).agg({"n_access": "sum", "n_hex": "sum", "n_random": "sum"}).first()
    assert list(left) == [0, 0, 0]
    assert out.where("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("rows", [0, 1])
def test_odd_tables(spark, folder, rows):
    odd = _rows([(1, None, None, None), (None, "word " * 30, "en", "a"), (3, "word " * 30, "en", "a"), (3, "word " * 30, "en", "a")])
    frame = spark.createDataFrame(odd * rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, folder)
        assert name == "packing" or frame.columns == SCHEMA.replace(" ", ",").replace(",,", ",").split(",")[::2]
    assert (frame.count() > 0) == (rows > 0)


def test_near_duplicates_judge_rows_not_ids(spark, folder, docs):
    rng = random.Random(9)
    one, two = (" ".join(f"q{rng.randrange(10**6)}" for _ in range(50)) for _ in range(2))
    odd = [(10**6 + 3, one), (10**6 + 7, one), (10**6 + 7, two), (None, one), (10**6 + 3, one), (None, None), (None, None)]
    more = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in odd], docs.schema))
    out = corpus_pipeline.near_duplicates(spark, more, folder).where("doc_id >= 1000000 or doc_id is null")
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(10**6 + 3, one), (10**6 + 7, two), (None, None), (None, None)])
