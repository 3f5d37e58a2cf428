"""Source divergence, substring removal and filter interactions against plain versions, SQL and odd tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from paneloom.llm import op11_divergence, op12_substrings, op13_interactions
from paneloom.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, _rows
from tests.oracle import compare, duckdb_connection


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty, blank, very long and repeated texts, repeated ids, clashing columns, shared passages."""
    rng = random.Random(8)
    vocabulary = [f"w{rng.randrange(900)}x" for _ in range(300)] + ["Über", "ÜBER", "über", "naïve", "a", "A", "#tag", "100%", "数", "\U0001f600"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, other, long = some(60), some(14), some(30_000)
    texts = [(1, None, "en", "a"), (2, "", None, None), (3, " \t\n\x0b ", "en", "a"), (None, passage, "de", "b"), (None, passage, None, "b"),
             (5, "one", "en", "a"), (6, "ONE", "en", "b"), (9, long, "en", "a"), (10, long + " end", "en", None), (4, other, "", ""), (7, "", "en", "a"),
             (12, "x " * 500, "en", "a"), (11, "x " * 40, "en", "b"), (13, "LOUD " * 250, "zz", "only"), (-4, other, "en", "b"), (8, other, "en", "b")]
    for i in range(20, 60):
        w = some(rng.choice([5, 12, 13, 40, 260])).split()
        at = rng.randrange(len(w) + 1)
        texts.append((i, " ".join(w[:at] + passage.split()[rng.randrange(30):][: rng.randrange(8, 40)] + w[at:]) + rng.choice(["", "\n", "  "]),
                      rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "é", "z", None])))
    same = some(230)
    texts += [(i, same, "en", "a") for i in (70, 71, 72, 72, 73, 74)] + [(70, same, "de", "b")]  # one doc_id twice
    texts += [(90, "alone", "qq", "a"), (91, "here", "qq", "b"), (80, passage + " " + other, "en", "a"), (80, other + " " + passage, "en", "a"), (81, passage.replace(" ", "\t\t"), "en", "c")]
    return spark.createDataFrame(_rows(texts), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("heavy, shard", [(10_000, 20_000), (2, 10)])
def test_substrings_as_brute_force(odd, heavy, shard):
    got = op12_substrings.without_repeats(odd, heavy, shard).collect()
    want = brute.without_repeats([(r.doc_id, r.text) for r in odd.collect()])
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(r.n_removed > 0 for r in got) > 30


def test_long_rows_of_one_word_and_hot_passages(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(1, "y " * 3000), (2, "y " * 900 + "z " * 20), (3, "z " * 14)]
    docs += [(i, f"u{i} v{i} {passage} t{i} " + " ".join(str(rng.random()) for _ in range(5))) for i in range(10, 400)]
    got = op12_substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), heavy=50, shard_phrases=100).collect()
    assert Counter(map(tuple, got)) == Counter(brute.without_repeats(docs))


def test_anchors_agree_in_equal_windows():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 50, 400).astype(np.uint64)
    hashes = op12_substrings.window_hashes(words, op12_substrings.ANCHOR)
    size = op12_substrings.WINDOW - op12_substrings.ANCHOR + 1
    least = op12_substrings.sliding_least(hashes, size)
    assert [min(hashes[i: i + size]) for i in range(len(least))] == list(least)
    assert len(op12_substrings.window_hashes(words[:4], 5)) == 0


def test_automaton_holds_windows_of_different_documents_only():
    a, b = tuple(range(1, 20)), tuple(range(5, 18))
    found = op12_substrings.automaton([a, b], [3, 7], [3, 7])
    assert list(found.iter(a)) == [(16, 3)] and list(found.iter(b)) == [(12, 3)]
    assert op12_substrings.automaton([a, b], [3, 3], [3, 3]) is None


@pytest.mark.parametrize("wave, keys, slot", [(48 << 20, 1 << 15, 96 << 20), (600, 20, 100)])
def test_divergence_as_brute_force(odd, monkeypatch, wave, keys, slot):
    monkeypatch.setattr(op11_divergence, "WAVE_BYTES", wave)
    monkeypatch.setattr(op11_divergence, "SHARD_KEYS", keys)
    monkeypatch.setattr(op11_divergence, "SLOT_BYTES", slot)
    monkeypatch.setattr(op11_divergence, "BLOCK", op11_divergence.BLOCK if keys > 20 else 30)
    got = op11_divergence.divergence(odd, top=30).collect()
    want = brute.divergence([(r.text, r.lang, r.source) for r in odd.collect()], top=30)
    assert Counter(map(tuple, got)) == Counter(want)
    assert {r.part for r in got} == {"pair", "term"} and any(r.value == 0 for r in got)


def test_perfect_hash_is_minimal_and_knows_its_keys():
    keys = [f"k{i}".encode() for i in range(5000)]
    hashes = op11_divergence._hashes(pa.array(keys, pa.large_binary()))
    levels, index = op11_divergence.perfect_hash(hashes)
    assert sorted(index) == list(range(5000)) and sum(int(x.sum()) for x in levels) == 5000
    twice = np.concatenate([hashes[:10], hashes[:3]])  # equal hashes of different keys
    levels, index = op11_divergence.perfect_hash(twice)
    assert sorted(index) == list(range(13)) and sorted(index[[0, 1, 2, 10, 11, 12]]) == [7, 8, 9, 10, 11, 12]


def test_lookups_reject_strangers_and_find_keys_of_equal_hash(monkeypatch):
    real = op11_divergence._hashes
    monkeypatch.setattr(op11_divergence, "_hashes", lambda keys: real(keys) % np.uint64(40))
    keys = pa.array([f"k{i}".encode() for i in range(100)], pa.large_binary())
    levels, index = op11_divergence.perfect_hash(op11_divergence._hashes(keys))
    order = keys.take(pa.array(np.argsort(index)))
    data, offsets = op11_divergence.text_bytes(order)
    row = {"lang": "en", "shard": 0, "n": 100, "sizes": [len(x) for x in levels], "bits": np.packbits(np.concatenate(levels)).tobytes(),
           "lengths": np.diff(offsets).astype(np.int32).tobytes(), "keys": data.tobytes()}
    held = op11_divergence.Hashes([row], {"en": 1})
    asked = pa.array([f"k{i}".encode() for i in range(150)], pa.large_binary())
    assert list(held.find("en", 0, asked, op11_divergence._hashes(asked))) == [*index, *[-1] * 50]


@pytest.mark.parametrize("most", [32 << 20, 3000])
def test_interactions_as_brute_force(spark, odd, most):
    labels = [(20, 1, 0), (21, 0, 1), (21, 1, None), (None, 1, 1), (70, None, 1), (72, 1, 0), (12, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = op13_interactions.audit(op13_interactions.failures(odd, most), frame).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got}
    assert len(got) == len(found)
    assert found == brute.interactions([(r.doc_id, r.text, r.lang) for r in odd.collect()], labels)


def test_prefixes_grow_where_texts_start_alike(spark):
    texts = [(i, "the same long start of many documents, " * 3 + f"{i % 7} tail") for i in range(100)] + [(i, f"{i} other") for i in range(100, 200)]
    rows = spark.createDataFrame([(i, ["en"], 0, t) for i, t in texts], op13_interactions.SIFTED)
    found = op13_interactions.prefixed(rows, 60_000).collect()
    assert Counter(r.text for r in found) == Counter(t for _, t in texts)
    assert len({r.prefix for r in found}) == 101
    found = op13_interactions.prefixed(rows, 20_000).collect()
    by = defaultdict(set)
    for r in found:
        assert r.text.startswith(r.prefix)
        by[r.text].add(r.prefix)
    assert max(map(len, by.values())) == 1 and len({r.prefix for r in found}) == 107


def test_trie_holds_least_ids():
    rng = random.Random(2)
    root, want = op13_interactions.Node(b""), defaultdict(list)
    for i in rng.sample(range(3000), 3000):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(9)))
        op13_interactions.insert(root, text, i, ())
        want[text].append(i)
    found = {tuple(sorted(x[0] for x in ends)): least for least, ends in op13_interactions.terminals(root)}
    assert found == {tuple(sorted(v)): min(v) for v in want.values()}


def test_empty_tables(spark, empty):
    assert op12_substrings.without_repeats(empty).count() == 0
    assert op11_divergence.divergence(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op13_interactions.audit(op13_interactions.failures(empty), labels).count() == 0
    one = spark.createDataFrame(_rows([(1, None, None, None)]), SCHEMA)
    assert [tuple(r)[1:3] for r in op12_substrings.without_repeats(one).collect()] == [(0, 0)]
    assert op11_divergence.divergence(one).count() == 0
    assert op13_interactions.audit(op13_interactions.failures(one), labels).count() == 600


@pytest.mark.parametrize("name", ["op11_divergence", "op12_substrings", "op13_interactions"])
def test_queries_match_sql(spark, folder, name):
    assert compare(QUERIES[name](spark, folder), duckdb_connection(folder), ORACLES[name]) == []
