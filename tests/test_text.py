"""Text features and entity matching on hand-made documents."""

import pytest
from pyspark.sql import functions as F

from paneloom.functions import strings as S
from paneloom.functions.arrays import char_grams, longest_run, wrapped_list
from paneloom.operators import text as tx


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


def test_token_grammar(spark):
    text = "In 2012, the 10-K showed 1,234 (3.5%) -- covid-19's été... $12345!"
    got = one(spark, text, tx.tokens)
    assert got == ["In", "2012", ",", "the", "10-K", "showed", "1,234", "(", "3.5", "%", ")", "-", "-", "covid-19's", "été", ".", ".", ".", "$", "12345", "!"]
    # 2012, 1,234 (a number up to its comma) and 3.5; not 10-K, covid-19 or five digits
    numeric = one(spark, text, lambda t: F.filter(tx.tokens(t), lambda x: x.rlike(tx.NUMERIC)))
    assert numeric == ["2012", "1,234", "3.5"]


@pytest.mark.parametrize("text", ["", "... !!", None])
def test_documents_without_words(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    r = tx.text_features(df, "id").first()
    assert r["mean_sentence_length"] is None and r["gf_score"] is None and r["num_q_by_len"] is None
    assert r["word_count"] in (0, None, -1)


def test_sentences_and_fog(spark):
    text = "Alpha beta. Gamma? Delta epsilon zeta no end"
    assert one(spark, text, lambda t: F.size(tx.sentences(t))) == 3
    long = ("The cat sat. " * 33 + "Magnificent banana.").strip()
    df = spark.createDataFrame([(1, long)], "id int, text string")
    r = tx.text_features(df, "id").first()
    assert r["word_count"] == 101 and r["n_sentences"] == 34
    assert r["gf_score"] == pytest.approx(0.4 * (101 / 34 + 100 * 2 / 101))
    assert tx.text_features(df.withColumn("text", F.lit("The cat sat.")), "id").first()["gf_score"] is None


def test_unusable_documents(spark):
    names = " ".join(f"Name{i}" for i in range(51))
    docs = [(1, "word " * 501), (2, "word " * 500), (3, "word " * 600 + names), (4, "word " * 600 + " ".join(names.split()[:50]))]
    df = spark.createDataFrame(docs, "id int, text string")
    assert sorted(r["id"] for r in tx.unusable_documents(df, "id").collect()) == [2, 3]


def test_runs_grams_and_lists(spark):
    words = lambda t: F.split(t, " ")
    assert one(spark, "A B c D E F g", lambda t: longest_run(words(t), lambda w: w.rlike("^[A-Z]"))) == 3
    assert one(spark, "abcab", char_grams) == ["abc", "bca", "cab"] and one(spark, "ab", char_grams) == ["ab"]
    assert one(spark, "a b c d", lambda t: wrapped_list(words(t))) == "a, b,\nc, d"


def test_string_helpers(spark):
    assert one(spark, "noise OPERATOR: go", lambda t: S.cut_from(t, "operator")) == "OPERATOR: go"
    assert one(spark, "no keyword", lambda t: S.cut_from(t, "operator")) == "no keyword"
    assert one(spark, "aaaa", lambda t: S.count_occurrences(t, "AA")) == 2
    assert one(spark, "verb | 12.5 % of", lambda t: S.number_between(t, "|", "%")) == 12.5
    assert one(spark, "no share", lambda t: S.number_between(t, "|", "%")) is None
    assert one(spark, "+AA-", lambda t: S.strip_chars(t, "+", "-")) == "AA"
    assert one(spark, "a\n\n\nb", S.collapse_newlines) == "a\nb"


def test_lexicon_build(spark):
    rows = [
        ("GOOD", "x", "Positiv", None), ("RUN#1", "| 40% verb", None, "Negativ"), ("RUN#2", "| 60% noun", "Positiv", None),
        ("BAD#1", "no share", None, "Negativ"), ("MIX", "x", "Positiv", "Negativ")]
    e = spark.createDataFrame(rows, "Entry string, Defined string, Positiv string, Negativ string")
    got = sorted(tuple(r) for r in tx.build_lexicon(e, ("Positiv", "Negativ")).collect())
    assert got == [("good", "Positiv"), ("mix", "Negativ"), ("mix", "Positiv"), ("run", "Positiv")]


def test_lexicon_counts_zero_fill(spark):
    lex = spark.createDataFrame([("good", "Positiv"), ("bad", "Negativ"), ("bad", "Strong")], "word string, category string")
    docs = spark.createDataFrame([(1, "Good good BAD."), (2, "nothing here"), (3, "")], "id int, text string")
    got = {r["id"]: (r["Positiv"], r["Negativ"], r["Strong"]) for r in tx.lexicon_counts(docs, lex, "id").collect()}
    assert got == {1: (2, 1, 1), 2: (0, 0, 0), 3: (0, 0, 0)}


def test_label_positivity(spark):
    df = spark.createDataFrame([(1, "Positive"), (1, "Positive"), (1, "Negative"), (2, "Neutral"), (3, "Failed")], "id int, label string")
    got = {r["id"]: round(r["score"], 6) for r in tx.label_positivity(df, "id", "label", failed="Failed").collect()}
    assert got == {1: 0.176091, 2: 0.0, 3: -1.0}


@pytest.mark.parametrize("raw,clean", [
    ("Acme Co.", "ACME"), ("Acme Cos.", "ACME"), ("Acme Networks Inc.", "ACME"), ("Alcoa Corp", "ALCOA"),
    ("Packaging Corp. of America", "PACKAGING CORP. OF AMERICA"), ("Service Corp. International", "SERVICE CORP."),
    ("Novartis AG", "NOVARTIS"), ("T-Mobile US Inc.", "T-MOBILE"), ("Amazon.com, Inc.", "AMAZON"), ("SAP SE", "SAP")])
def test_names(spark, raw, clean):
    assert one(spark, raw, tx.normalise_name) == clean


def test_mentions_and_links(spark):
    docs = spark.createDataFrame([(1, "Acme and Big Blue met acme."), (2, "GAAP results of Big Blue"), (3, "none")], "doc int, text string")
    names = spark.createDataFrame([("Acme",), ("big blue",), ("GAAP",)], "name string")
    found = tx.mentions(docs, names, "doc")
    assert sorted(tuple(r) for r in found.collect()) == [(1, "ACME", 2), (1, "BIG BLUE", 1), (2, "BIG BLUE", 1), (2, "GAAP", 1)]
    link = spark.createDataFrame([(1, "ACME"), (2, "BIG BLUE"), (9, "GAAP")], "matched_key int, clean_name string")
    panel = spark.createDataFrame([(1,), (2,)], "doc int")
    got = sorted((r["doc"], r["company_mentioned"], r["matched_key"]) for r in tx.link_mentions(found, link, panel, "doc").collect())
    assert got == [(1, "BIG BLUE", 2)]
    s = tx.mention_summary(docs, found, "doc").first()
    assert (s["n_docs"], s["n_docs_with"]) == (3, 2) and s["mean_mentions"] == pytest.approx(5 / 3) and s["mean_mentions_nonzero"] == 2.5


def test_lemmas(spark):
    w = spark.createDataFrame([("running",), ("cities",), ("mice",), ("cat",)], "word string")
    table = spark.createDataFrame([("mice", "mouse")], "word string, lemma string")
    got = dict(tx.lemmatise(w, table, (("ies", "y"), ("ing", ""))).select("word", "lemma").collect())
    assert got == {"running": "runn", "cities": "city", "mice": "mouse", "cat": "cat"}


def test_names_of_any_length_and_with_marks_are_found(spark):
    docs = spark.createDataFrame([(1, "said A.B. Smith and The Very Long Name Of A Firm today"), (2, "Smith alone")], "doc int, text string")
    names = spark.createDataFrame([("A.B. Smith",), ("The very long name of a firm",), ("???",), ("Jones",)], "name string")
    got = sorted(tuple(r) for r in tx.mentions(docs, names, "doc").collect())
    assert got == [(1, "A.B. SMITH", 1), (1, "THE VERY LONG NAME OF A FIRM", 1)]


def test_shuffled_mentions_equal_broadcast_ones(spark):
    docs = spark.createDataFrame([(1, "Big Firm met Small Firm and Big Firm"), (2, "nothing")], "doc int, text string")
    names = spark.createDataFrame([("Big Firm",), ("Small firm",), ("Firm",)], "name string")
    one_way = sorted(map(tuple, tx.mentions(docs, names, "doc").collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, tx.mentions(docs, names, "doc").collect())) == one_way != []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_documents_without_sentences_score_zero(spark):
    docs = spark.createDataFrame([(1, "good."), (2, "..."), (3, None)], "id int, text string")
    lexicon = spark.createDataFrame([("good", "Positiv")], "word string, category string")
    out = tx.label_positivity(tx.sentence_labels(docs, lexicon, "id"), "id", "label", docs=docs)
    assert {r["id"]: (r["n_positive"], round(r["score"], 6)) for r in out.collect()} == {1: (1, 0.30103), 2: (0, 0.0), 3: (0, 0.0)}
