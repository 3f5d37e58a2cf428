"""Text analytics on the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as ml
from ..operators import moments as mo
from ..operators import text as tx
from ..session import stored
from .base import query
from .standins import SQL_FIRMS, SQL_LEXICON, SQL_WORD, entries, firms, sql_best_match, sql_tokens, sql_words

NUM = r"$$^[0-9]{1,4}(?:,[0-9])*(?:\.[0-9]+)?(?:$|[^A-Za-z0-9_.-])$$"
_HARD = r"$$[aeiouy][^aeiouy]+[aeiouy]+[^aeiouy]+[aeiouy]$$"
SENT = f"[s for s in regexp_extract_all(text, $$[^.!?]+[.!?]*$$) if regexp_matches(s, {SQL_WORD})]"
_WORDS = f"with_words as (select *, {sql_words()} as ws from documents)"
_COUNTS = f"word_counts as (select doc_id, lower(unnest({sql_words()})) as word, 1 as one from documents)"


def docs(t):
    return t.documents


def text_docs(t):
    return docs(t).select("doc_id", "text")


def lexicon(t):
    return tx.build_lexicon(entries(t))


@query("tx1_tokenise", f"""
    with k as (select doc_id, {sql_tokens()} as ts from documents)
    select doc_id, len(ts) as n_tokens, md5(array_to_string(ts, chr(9))) as digest from k""")
def _(t):
    k = text_docs(t).select("doc_id", tx.tokens(F.col("text")).alias("ts"))
    return k.select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.md5(F.array_join("ts", "\t")).alias("digest"))


@query("tx2_sentences", f"""
    with k as (select doc_id, len({SENT}) as n, len({sql_words()}) as w from documents)
    select doc_id, n as n_sentences, round(w / nullif(n, 0), 4) as mean_length from k""")
def _(t):
    k = text_docs(t).select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("n_sentences"),
                            F.size(tx.words(tx.tokens(F.col("text")))).alias("w"))
    return k.select("doc_id", "n_sentences", F.round(tx.ratio(F.col("w"), F.col("n_sentences")), 4).alias("mean_length"))


@query("tx3_word_count", f"select doc_id, len({sql_words()}) as word_count from documents")
def _(t):
    return text_docs(t).select("doc_id", F.size(tx.words(tx.tokens(F.col("text")))).cast("long").alias("word_count"))


_SQL_RUNS = f"""runs as (select doc_id, len(ws) as word_count, coalesce(list_max([length(r) for r in
    regexp_extract_all(array_to_string([case when regexp_matches(w, $$^\\p{{Lu}}$$) then '1' else '0' end for w in ws], ''), '1+')]), 0) as capital_run from with_words)"""


@query("tx4_unusable_documents", f"""
    with {_WORDS}, {_SQL_RUNS} select doc_id, word_count, capital_run from runs where word_count <= 500 or capital_run > 50""")
def _(t):
    bad = tx.unusable_documents(text_docs(t), "doc_id")
    return bad.select("doc_id", F.col("word_count").cast("long").alias("word_count"), F.col("capital_run").cast("long").alias("capital_run"))


@query("tx5_numeric_transparency", f"""
    with k as (select doc_id, {sql_tokens()} as ts from documents)
    select doc_id, round(len([x for x in ts if regexp_matches(x, {NUM})]) / nullif(len(list_distinct([x for x in ts if not regexp_matches(x, {NUM})])), 0), 2) as num_transparency from k""")
def _(t):
    return text_docs(t).select("doc_id", tx.tokens(F.col("text")).alias("ts")).select(
        "doc_id", tx.numeric_transparency(F.col("ts")).alias("num_transparency"))


@query("tx6_fog", f"""
    with {_WORDS}, k as (select doc_id, len(ws) as n, len({SENT}) as s, len([w for w in ws if regexp_matches(lower(w), {_HARD})]) as h from with_words)
    select doc_id, case when n >= 100 then round(0.4 * (n / nullif(s, 0) + 100 * (h / nullif(n, 0))), 4) end as gf_score from k""")
def _(t):
    k = text_docs(t).select("doc_id", tx.words(tx.tokens(F.col("text"))).alias("ws"), F.size(tx.sentences(F.col("text"))).alias("s"))
    return k.select("doc_id", F.round(tx.fog(F.col("ws"), F.col("s")), 4).alias("gf_score"))


# The texts hold few question marks, so a full stop counts as the mark here.
@query("tx7_question_features", f"""
    with {_WORDS}, k as (select doc_id, length(text) - length(replace(text, '.', '')) as q, len(ws) as n from with_words)
    select doc_id, q as num_questions, round(q / nullif(n, 0), 6) as per_word, round(n / nullif(q, 0), 6) as words_per_question,
        round(1000 * (q / nullif(n, 0)), 4) as per_1000 from k""")
def _(t):
    f = tx.text_features(text_docs(t), "doc_id", "text", question=".")
    return f.select("doc_id", "num_questions", F.round("num_q_by_len", 6).alias("per_word"),
                    F.round("words_per_question", 6).alias("words_per_question"), F.round("questions_per_1000", 4).alias("per_1000"))


@query("tx8_lexicon_build", f"with {SQL_LEXICON} select word, category from lexicon")
def _(t):
    return tx.build_lexicon(entries(t))


_SQL_HITS = f"""{SQL_LEXICON}, {_COUNTS}, hits as (
    select d.doc_id, {", ".join(f"count(*) filter (where category = '{c}') as {c}" for c in tx.TONES)}
    from documents d left join word_counts w on d.doc_id = w.doc_id left join lexicon l on w.word = l.word group by d.doc_id)"""


@query("tx9_category_counts", f"with {_SQL_HITS} select * from hits")
def _(t):
    return tx.lexicon_counts(text_docs(t), lexicon(t), "doc_id")


@query("tx10_opposed_ratios", f"""
    with {_SQL_HITS} select doc_id, {", ".join(f"round({a} / nullif({b}, 0), 6) as {n}" for n, (a, b) in tx.TONE_PAIRS.items())} from hits""")
def _(t):
    r = tx.tone_ratios(tx.lexicon_counts(text_docs(t), lexicon(t), "doc_id"))
    return r.select("doc_id", *[F.round(n, 6).alias(n) for n in tx.TONE_PAIRS])


_T = [f"t{i}" for i in range(4)]
_CORR = [[f"m{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(4)]
_TIMES = [" + ".join(f"{_CORR[i][j]} * v{j}" for j in range(4)) for i in range(4)]


# The leading eigenvector of the correlations by repeated multiplication.
@query("tx10_first_component", f"""
    with recursive {_SQL_HITS}, r as (select doc_id, {", ".join(f"{a} / nullif({b}, 0) as {x}" for x, (a, b) in zip(_T, tx.TONE_PAIRS.values()))} from hits),
    known as (select * from r where {" and ".join(f"{x} is not null" for x in _T)}),
    m as materialized (select {", ".join(f"corr({_T[i]}, {_T[j]}) as m{i}{j}" for i in range(4) for j in range(i, 4))},
        {", ".join(f"avg({x}) as a{i}, stddev_pop({x}) as d{i}" for i, x in enumerate(_T))} from known),
    w as (select 0 as step, 0.9::double as v0, 0.8::double as v1, 0.7::double as v2, 0.6::double as v3
        union all select step + 1, {", ".join(f"x{i} / sqrt(x0 * x0 + x1 * x1 + x2 * x2 + x3 * x3)" for i in range(4))}
        from (select step, {", ".join(f"{e} as x{i}" for i, e in enumerate(_TIMES))} from w, m where step < 3000)),
    e as (select *, greatest(v0, v1, v2, v3) as hi, least(v0, v1, v2, v3) as lo from w where step = 3000),
    f as (select case when abs(lo) > hi then -1 else 1 end as sign, * from e)
    select r.doc_id, round(case when {" and ".join(f"{x} is not null" for x in _T)} then sign * ({" + ".join(f"v{i} * ({x} - a{i}) / d{i}" for i, x in enumerate(_T))}) end, 5) as tone
    from r, f, m""")
def _(t):
    r = tx.tone_ratios(tx.lexicon_counts(text_docs(t), lexicon(t), "doc_id"))
    r = stored(r.select("doc_id", *tx.TONE_PAIRS), "tones")
    return mo.first_component(r, list(tx.TONE_PAIRS), "tone").select("doc_id", F.round("tone", 5).alias("tone"))


@query("tx11_net_positivity", f"""
    with {_SQL_HITS} select doc_id, round(log10((Positiv + 1.0) / (Negativ + 1.0)), 6) as positivity from hits""")
def _(t):
    hits = tx.lexicon_counts(text_docs(t), lexicon(t), "doc_id", categories=("Positiv", "Negativ"))
    return hits.select("doc_id", F.round(tx.smoothed_log_ratio(F.col("Positiv"), F.col("Negativ")), 6).alias("positivity"))


@query("tx12_label_positivity", f"""
    with {SQL_LEXICON}, polar as (select word, sum(case category when 'Positiv' then 1 else -1 end) as sign from lexicon where category in ('Positiv', 'Negativ') group by 1),
    parts as (select doc_id, generate_subscripts(ss, 1) as i, unnest(ss) as s from (select doc_id, {SENT} as ss from documents)),
    pw as (select doc_id, i, lower(unnest({sql_words("s")})) as word from parts),
    b as (select doc_id, i, sum(coalesce(sign, 0)) as b from pw left join polar using (word) group by 1, 2),
    c as (select doc_id, count(*) filter (where b > 0) as n_positive, count(*) filter (where b < 0) as n_negative from b group by 1)
    select doc_id, coalesce(n_positive, 0) as n_positive, coalesce(n_negative, 0) as n_negative,
        round(log10((coalesce(n_positive, 0) + 1.0) / (coalesce(n_negative, 0) + 1.0)), 6) as score from documents left join c using (doc_id)""")
def _(t):
    labels = tx.sentence_labels(text_docs(t), lexicon(t), "doc_id")
    out = tx.label_positivity(labels, "doc_id", "label", docs=t.documents)
    return out.withColumn("score", F.round("score", 6))


_STOP = ("the", "of", "and", "is", "in", "le", "la", "der", "die", "de")


def _stop(t):
    """Stop list as a table: the words of the list that occur in the passages."""
    words = t.benchmark.select(F.explode(tx.words(tx.tokens(F.lower("text")))).alias("word"))
    return words.where(F.col("word").isin(*_STOP)).distinct()


_SQL_STOP = f"""stop as (select distinct word from (select unnest({sql_words("lower(text)")}) as word from benchmark)
    where word in ({", ".join(f"'{w}'" for w in _STOP)}))"""


@query("tx13_term_frequency", f"""
    with {_SQL_STOP}, {_COUNTS} select word, count(*) as n from word_counts where word not in (select word from stop) group by word""")
def _(t):
    return tx.term_frequency(docs(t).select("text"), _stop(t))


@query("tx13_term_frequency_by_group", f"""
    with {_SQL_STOP}, w as (select lang, lower(unnest({sql_words()})) as word from documents)
    select lang, word, count(*) as n from w where word not in (select word from stop) group by 1, 2""")
def _(t):
    return tx.term_frequency(docs(t).select("lang", "text"), _stop(t), ["lang"])


@query("tx14_phrase_share", f"""
    with p as (select doc_id, lang, cast((length(lower(text)) - length(replace(lower(text), 'of the', ''))) / 6 as bigint) as n, len({sql_words()}) - 1 as pairs from documents)
    select lang, round(avg(n), 6) as mean_count, round(avg(case when pairs > 0 then n / pairs end), 8) as mean_share from p group by lang""")
def _(t):
    p = tx.phrase_share(docs(t), "doc_id", "of the", keep=["lang"])
    return p.groupBy("lang").agg(
        F.round(F.avg("n_phrase"), 6).alias("mean_count"), F.round(F.avg("share"), 8).alias("mean_share"))


def names(t):
    """Names to look for: the first one, two and three words of each passage."""
    w = t.benchmark.select("item_id", tx.words(tx.tokens(F.col("text"))).alias("w"))
    parts = F.array(*[F.struct(F.lit(n).alias("size"), F.array_join(F.slice("w", 1, n), " ").alias("name")) for n in (1, 2, 3)])
    return w.where(F.size("w") >= 3).select("item_id", F.inline(parts))


_SQL_NAMES = f"""bw as (select item_id, {sql_words()} as w from benchmark),
    names as (select item_id, size, replace(replace(upper(array_to_string(w[1:size], ' ')), 'ß', 'SS'), 'ẞ', 'SS') as name from bw, (values (1), (2), (3)) s(size) where len(w) >= 3),
    dw as (select doc_id, [replace(replace(upper(w), 'ß', 'SS'), 'ẞ', 'SS') for w in {sql_words()}] as w from documents),
    found as (select doc_id, unnest(flatten([[array_to_string(w[i:i + n - 1], ' ') for i in range(1, len(w) - n + 2)] for n in range(1, 5)])) as company_mentioned from dw),
    mentions as (select doc_id, company_mentioned, count(*) as n from found where company_mentioned in (select name from names) group by 1, 2)"""


@query("tx15_mentions", f"with {_SQL_NAMES} select doc_id, company_mentioned, n from mentions")
def _(t):
    return tx.mentions(text_docs(t), names(t), "doc_id")


def _sql_normalised(expr: str) -> str:
    x = f"upper({expr})"
    for a, b in tx.NAME_RULES:
        x = f"replace({x}, '{a}', '{b}')"
    x = f"trim({x})"
    for p in tx.NAME_ENDINGS:
        x = f"regexp_replace({x}, '{p}', '')"
    return rf"regexp_replace(trim({x}), '[^\w\s]$', '')"


_RAW = "concat(p_name, case p_size % 6 when 0 then ' Corp.' when 1 then ' Holdings Inc.' when 2 then ' Networks & Co.' when 3 then ' Co Ltd' when 4 then ', Inc' else ' Partners LP!' end)"


def _raw_names(t):
    tail = F.lit(" Partners LP!")
    for i, s in enumerate((" Corp.", " Holdings Inc.", " Networks & Co.", " Co Ltd", ", Inc")):
        tail = F.when(F.col("p_size") % 6 == i, s).otherwise(tail)
    return t.part.select("p_partkey", F.concat("p_name", tail).alias("raw"))


@query("tx16_normalise_names", f"select p_partkey, {_sql_normalised(_RAW)} as name from part")
def _(t):
    return _raw_names(t).select("p_partkey", tx.normalise_name(F.col("raw")).alias("name"))


@query("tx17_link_exact", f"""
    with {_SQL_NAMES}, used as (select distinct doc_id from labels where quality = 1)
    select m.doc_id, m.company_mentioned, m.n, x.item_id as matched_key from mentions m
    join (select distinct item_id, name from names where size > 1) x on m.company_mentioned = x.name and m.doc_id <> x.item_id
    where m.doc_id in (select doc_id from used) and m.company_mentioned <> 'GAAP'""")
def _(t):
    listed = names(t)
    linkable = listed.where("size > 1").select(F.col("item_id").alias("matched_key"), F.upper("name").alias("clean_name")).distinct()
    found = tx.mentions(text_docs(t), listed, "doc_id")
    return tx.link_mentions(found, linkable, t.labels.where("quality = 1"), "doc_id")


_FIRM_RAW = "concat(name, case doc_id % 6 when 0 then ' Corp.' when 1 then ' Holdings Inc.' when 2 then ' Co.' when 3 then ' Co Ltd' when 4 then ', Inc' else ' LP!' end)"


@query("tx18_link_fuzzy", f"""
    with {SQL_FIRMS}, raw as (select {_FIRM_RAW} as raw from firms), said as (select upper(raw) as name from raw),
    clean as (select {_sql_normalised("raw")} as name from raw),
    {sql_best_match("said", "clean", "name", "clean_name", 0.7, not_equal=True)}""")
def _(t):
    from ..operators.joins import fuzzy_best_match

    raw = firms(t).select(F.expr(_FIRM_RAW).alias("raw"))
    a = raw.select(F.upper("raw").alias("name"))
    b = raw.select(tx.normalise_name(F.col("raw")).alias("clean_name"))
    out = fuzzy_best_match(a, b, "name", "clean_name", threshold=0.7, not_equal=True)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("tx19_mention_summary", f"""
    with {_SQL_NAMES}, per as (select doc_id, sum(n) as m, count(*) as e from mentions group by 1),
    a as (select coalesce(m, 0) as m, coalesce(e, 0) as e from documents left join per using (doc_id))
    select count(*) as n_docs, count(*) filter (where m > 0) as n_docs_with, round(avg(case when m > 0 then 1.0 else 0.0 end), 6) as share_with,
        round(avg(m), 6) as mean_mentions, round(avg(e), 6) as mean_entities,
        round(avg(case when m > 0 then m end), 6) as mean_mentions_nonzero, round(avg(case when m > 0 then e end), 6) as mean_entities_nonzero from a""")
def _(t):
    s = tx.mention_summary(t.documents, tx.mentions(text_docs(t), names(t), "doc_id"), "doc_id")
    means = [c for c in s.columns if c.startswith(("share", "mean"))]
    return s.withColumns({c: F.round(c, 6) for c in means})


@query("tx20_embeddings")
def _(t):
    tokens = text_docs(t).select("doc_id", F.transform(tx.words(tx.tokens(F.col("text"))), lambda w: F.lower(w)).alias("words"))
    return ml.embed(tokens, "words", size=16).select("doc_id", "embedding")


_SUFFIXES = (("ies", "y"), ("ing", ""), ("ed", ""), ("s", ""))


@query("tx21_lemmas", f"""
    with {_COUNTS}, w as (select word, count(*) as n from word_counts group by 1),
    passages as (select distinct lower(unnest({sql_words()})) as word from benchmark),
    lemmas as (select word, substr(word, 1, length(word) - 2) as lemma from passages where length(word) > 8)
    select w.word, n, coalesce(lemma, case {" ".join(f"when ends_with(w.word, '{a}') then regexp_replace(w.word, '{a}$', '{b}')" for a, b in _SUFFIXES)} else w.word end) as lemma
    from w left join lemmas l on w.word = l.word""")
def _(t):
    vocabulary = tx.word_counts(docs(t).select("text"), [])
    passages = t.benchmark.select(F.explode(tx.words(tx.tokens(F.col("text")))).alias("_w")).select(F.lower("_w").alias("word")).distinct()
    lemmas = passages.where(F.length("word") > 8).select("word", F.expr("substr(word, 1, length(word) - 2)").alias("lemma"))
    return tx.lemmatise(vocabulary, lemmas, _SUFFIXES)


_TONE_NAMES = {c: c.lower() for c in tx.TONES}


@query("tx22_feature_table", f"""
    with {_SQL_HITS}, {_WORDS}, f as (select doc_id, len(ws) as word_count, length(text) - length(replace(text, '.', '')) as q, len({SENT}) as n_sentences from with_words)
    select l.doc_id, l.quality, f.word_count, f.n_sentences, {", ".join(f"h.{c} as {n}" for c, n in _TONE_NAMES.items())},
        round(f.q / nullif(f.word_count, 0), 6) as questions_by_len, round(1000 * (f.q / nullif(f.word_count, 0)), 4) as questions_per_1000,
        round(log10((h.Positiv + 1.0) / (h.Negativ + 1.0)), 6) as positivity, {", ".join(f"round(h.{a} / nullif(h.{b}, 0), 6) as {n}" for n, (a, b) in tx.TONE_PAIRS.items())}
    from labels l join f on l.doc_id = f.doc_id join hits h on l.doc_id = h.doc_id where f.word_count <= 5000 and f.word_count > 0""")
def _(t):
    d = text_docs(t)
    f = tx.text_features(d, "doc_id", question=".").select("doc_id", "word_count", "n_sentences", "num_q_by_len", "questions_per_1000")
    h = tx.tone_ratios(tx.lexicon_counts(d, lexicon(t), "doc_id"))
    positivity = tx.smoothed_log_ratio(F.col("Positiv"), F.col("Negativ"))
    rows = t.labels.select("doc_id", "quality").join(f, "doc_id").where("word_count <= 5000 and word_count > 0").join(h, "doc_id")
    return rows.select(
        "doc_id", "quality", F.col("word_count").cast("long").alias("word_count"), F.col("n_sentences").cast("long").alias("n_sentences"),
        *[F.col(c).alias(n) for c, n in _TONE_NAMES.items()], F.round("num_q_by_len", 6).alias("questions_by_len"),
        F.round("questions_per_1000", 4).alias("questions_per_1000"), F.round(positivity, 6).alias("positivity"),
        *[F.round(n, 6).alias(n) for n in tx.TONE_PAIRS])


@query("tx23_example_finder", f"""
    with {_SQL_NAMES}, best as (select company_mentioned, arg_max(doc_id, (n, -doc_id)) as doc_id, max(n) as n from mentions group by 1)
    select company_mentioned, b.doc_id, b.n, md5(d.text) as digest from best b join documents d on b.doc_id = d.doc_id""")
def _(t):
    found = tx.mentions(text_docs(t), names(t), "doc_id")
    best = found.groupBy("company_mentioned").agg(
        F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("doc_id"), F.max("n").alias("n"))
    # Only the texts that are shown are hashed.
    return stored(best, "best").join(text_docs(t), "doc_id").select("company_mentioned", "doc_id", "n", F.md5("text").alias("digest"))
