"""Text features over document tables.

Token grammar: a word is a run of letters and digits, joined inside by ``. ' - _``
(so ``10-K`` and ``covid-19`` are one token) or by a comma before a digit; every other
mark is a token of its own. The patterns use no lookaround, so any RE2 engine gives
the same tokens.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import longest_run
from ..functions.numbers import ratio, smoothed_log_ratio
from ..functions.strings import count_occurrences, number_between, override, remove_patterns, replace_chain, split_first
from ..session import stored

TOKEN = r"[\p{L}\p{N}]+(?:[.'’_-][\p{L}\p{N}]+|,\p{N}+)*|[^\s\p{L}\p{N}]"
SENTENCE = r"[^.!?]+[.!?]*"
WORD_CHAR = r"[\p{L}\p{N}]"
# Fixed value: what counts as a number.
NUMERIC = r"^[0-9]{1,4}(?:,[0-9])*(?:\.[0-9]+)?(?:$|[^A-Za-z0-9_.-])"
THREE_SYLLABLES = r"[aeiouy][^aeiouy]+[aeiouy]+[^aeiouy]+[aeiouy]"
CAPITALISED = r"^\p{Lu}"

# Tone categories, in opposed pairs.
TONES = ("Positiv", "Negativ", "Strong", "Weak", "Active", "Passive", "Ovrst", "Undrst")
TONE_PAIRS = {
    "PN": ("Positiv", "Negativ"),
    "SW": ("Strong", "Weak"),
    "AP": ("Active", "Passive"),
    "OU": ("Ovrst", "Undrst"),
}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(token_array: Column) -> Column:
    """Tokens that hold a letter or digit."""
    return F.filter(token_array, lambda t: t.rlike(WORD_CHAR))


def sentences(text: Column) -> Column:
    """Sentences with at least one letter or digit."""
    parts = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(parts, lambda s: s.rlike(WORD_CHAR))


def computed_once(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that later filters use but must not compute again.

    A filter on a projected column is pushed below the projection with a copy of the
    expression. Generated columns stop that: each value is computed once per row.
    """
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    return df.select("*", F.inline(F.array(row)))


def numeric_transparency(token_array: Column) -> Column:
    """Numeric tokens per distinct non-numeric token, two decimals."""
    numeric = F.size(F.filter(token_array, lambda t: t.rlike(NUMERIC)))
    types = F.size(F.array_distinct(F.filter(token_array, lambda t: ~t.rlike(NUMERIC))))
    return F.round(ratio(numeric, types), 2)


def fog(word_array: Column, n_sentences: Column) -> Column:
    """Gunning-Fog index 0.4 (words/sentences + 100 complex/words), null under 100 words."""
    n = F.size(word_array)
    hard = F.size(F.filter(word_array, lambda w: F.lower(w).rlike(THREE_SYLLABLES)))
    score = 0.4 * (ratio(n, n_sentences) + 100 * ratio(hard, n))
    return F.when(n >= 100, score)


def with_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``tokens`` and ``words`` once, for the features to share."""
    return docs.withColumn("tokens", tokens(F.col(text))).withColumn("words", words(F.col("tokens")))


def text_features(docs: DataFrame, key: str, text: str = "text", question: str = "?") -> DataFrame:
    """All per-document statistics in one scan of the text."""
    base = (
        with_tokens(docs, text)
        .withColumn("n_sentences", F.size(sentences(F.col(text))))
        .withColumn("word_count", F.size("words"))
        .withColumn("num_questions", count_occurrences(F.col(text), question))
    )
    return base.select(
        key,
        "word_count",
        "n_sentences",
        ratio(F.col("word_count"), F.col("n_sentences")).alias("mean_sentence_length"),
        numeric_transparency(F.col("tokens")).alias("num_transparency"),
        fog(F.col("words"), F.col("n_sentences")).alias("gf_score"),
        "num_questions",
        ratio(F.col("num_questions"), F.col("word_count")).alias("num_q_by_len"),
        ratio(F.col("word_count"), F.col("num_questions")).alias("words_per_question"),
        (1000 * ratio(F.col("num_questions"), F.col("word_count"))).alias("questions_per_1000"),
        longest_run(F.col("words"), lambda w: w.rlike(CAPITALISED)).alias("capital_run"),
    )


def unusable(word_count: Column, capital_run: Column, min_words: int = 500, max_run: int = 50) -> Column:
    """Too short, or a long run of capitalised tokens (a list of names, not a transcript)."""
    return (word_count <= min_words) | (capital_run > max_run)


def unusable_documents(docs: DataFrame, key: str, text: str = "text", min_words: int = 500, max_run: int = 50) -> DataFrame:
    """Documents to drop, with the two counts that decide."""
    found = docs.select(key, words(tokens(F.col(text))).alias("_w"))
    counted = computed_once(
        found,
        word_count=F.size("_w"),
        capital_run=longest_run(F.col("_w"), lambda w: w.rlike(CAPITALISED)),
    )
    bad = unusable(F.col("word_count"), F.col("capital_run"), min_words, max_run)
    return counted.where(bad).select(key, "word_count", "capital_run")


def exploded_words(docs: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """One row per word occurrence, lower case."""
    found = words(tokens(F.col(text)))
    return docs.select(*key, F.explode(found).alias("_w")).select(*key, F.lower("_w").alias("word"))


def word_counts(docs: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Occurrences of each word per key; combined on the map side before any shuffle."""
    return exploded_words(docs, key, text).groupBy(*key, "word").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- lexicon


def build_lexicon(entries: DataFrame, categories: Sequence[str] = TONES) -> DataFrame:
    """(word, category) from an entry table with one nullable mark per category.

    Entries without ``#`` count as they are. Of the numbered senses ``root#n`` the one
    with the highest frequency (the percentage after the first pipe of ``Defined``)
    counts; senses without a frequency are dropped.
    """
    single = entries.where(~F.col("Entry").contains("#")).withColumn("word", F.lower("Entry"))
    best = Window.partitionBy("_root").orderBy(F.desc("_freq"), "Entry")
    senses = (
        entries.where(F.col("Entry").contains("#"))
        .withColumn("_freq", number_between(F.col("Defined"), "|", "%"))
        .where("_freq is not null")
        .withColumn("_root", split_first(F.col("Entry"), "#")[0])
        .withColumn("_r", F.row_number().over(best))
        .where("_r = 1")
        .withColumn("word", F.lower("_root"))
    )
    marks = ["word", *categories]
    marked = F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in categories])
    return (
        single.select(*marks)
        .unionByName(senses.select(*marks))
        .select("word", F.explode(F.array_compact(marked)).alias("category"))
        .distinct()
    )


def lexicon_counts(
    docs: DataFrame,
    lexicon: DataFrame,
    key: str,
    text: str = "text",
    categories: Sequence[str] = TONES,
) -> DataFrame:
    """Hits per document and category, zero for documents without any.

    The lexicon becomes a written table with a row per word and a 0/1 column per category, so a
    word meets one row and Spark broadcasts the lexicon if it is measured to be small; only
    sums per document are shuffled then. Words without an entry stay in the join, so
    every document keeps a row and the texts are read once.
    """
    marks = [F.max((F.col("category") == c).cast("long")).alias(f"_{c}") for c in categories]
    per_word = stored(lexicon.groupBy("word").agg(*marks), "lexicon")
    lowered = F.transform(words(tokens(F.col(text))), lambda w: F.lower(w))
    found = docs.select(key, F.explode_outer(lowered).alias("word")).join(per_word, "word", "left")
    return found.groupBy(key).agg(*[F.coalesce(F.sum(f"_{c}"), F.lit(0)).alias(c) for c in categories])


def tone_ratios(counts: DataFrame) -> DataFrame:
    """Quotients of the opposed tone categories, null on a zero denominator."""
    return counts.withColumns({n: ratio(F.col(a), F.col(b)) for n, (a, b) in TONE_PAIRS.items()})


def label_positivity(
    labelled: DataFrame, key: str, label: str, failed: str | None = None, docs: DataFrame | None = None
) -> DataFrame:
    """Net positivity of a document from its sentence labels.

    log10((positive + 1) / (negative + 1)); -1 where a sentence is marked as failed. With
    ``docs`` each of its keys gets a row: a document without sentences has score 0.
    """
    sums = labelled.groupBy(key).agg(
        F.count_if(F.col(label) == "Positive").alias("n_positive"),
        F.count_if(F.col(label) == "Negative").alias("n_negative"),
        F.count_if(F.col(label) == failed if failed else F.lit(False)).alias("_failed"),
    )
    if docs is not None:
        sums = docs.select(key).join(sums, key, "left").fillna(0, subset=["n_positive", "n_negative", "_failed"])
    score = smoothed_log_ratio(F.col("n_positive"), F.col("n_negative"))
    return sums.withColumn("score", F.when(F.col("_failed") > 0, -1.0).otherwise(score)).drop("_failed")


def sentence_labels(docs: DataFrame, lexicon: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Default labeller: sign of positive minus negative lexicon hits per sentence."""
    parts = docs.select(key, F.posexplode(sentences(F.col(text))).alias("sentence", "_s"))
    polar = lexicon.where(F.col("category").isin("Positiv", "Negativ")).groupBy("word").agg(
        F.sum(F.when(F.col("category") == "Positiv", 1).otherwise(-1)).alias("_sign")
    )
    polar = stored(polar, "polar")
    balance = (
        exploded_words(parts, [key, "sentence"], "_s").join(polar, "word", "left")
        .groupBy(key, "sentence")
        .agg(F.sum(F.coalesce("_sign", F.lit(0))).alias("_b"))
    )
    label = F.when(F.col("_b") > 0, "Positive").when(F.col("_b") < 0, "Negative").otherwise("Neutral")
    return balance.select(key, "sentence", label.alias("label"))


# ---------------------------------------------------------------- terms


def term_frequency(docs: DataFrame, stop: DataFrame, by: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Occurrences of each word outside the stop list, overall or per group.

    Counted before the stop list is applied, so the anti-join sees distinct words.
    """
    return word_counts(docs, by, text).join(stop, "word", "left_anti")


def lemmatise(word_table: DataFrame, lemmas: DataFrame, suffixes: Sequence[tuple[str, str]]) -> DataFrame:
    """Lemma of each word: table entry, else the first matching suffix rule, else the word."""
    word = F.col("word")
    rule = word
    for ending, replacement in reversed(list(suffixes)):
        stem = F.regexp_replace(word, ending + "$", replacement)
        rule = F.when(word.endswith(ending), stem).otherwise(rule)
    return word_table.join(lemmas, "word", "left").withColumn("lemma", F.coalesce("lemma", rule))


def phrase_share(docs: DataFrame, key: str, phrase: str, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Occurrences of a two-word phrase and their share of all word pairs; ``keep``: further columns."""
    n = count_occurrences(F.col(text), phrase)
    pairs = F.size(words(tokens(F.col(text)))) - 1
    return docs.select(key, *keep, n.alias("n_phrase"), pairs.alias("n_pairs")).withColumn(
        "share", ratio(F.col("n_phrase"), F.when(F.col("n_pairs") > 0, F.col("n_pairs")))
    )


# ---------------------------------------------------------------- entities

# Literal replacements on upper-case firm names, applied in this order.
NAME_RULES = (
    ("GROUP HOLDING LIMITED", ""),
    ("& CO.", ""),
    ("(THE)", ""),
    ("RESORT PROPERTIES FINANCE INC.", ""),
    ("OPERATING CO., LLC", ""),
    ("(FINANCE I) B.V.", ""),
    ("NOVARTIS AG", "NOVARTIS"),
    ("COMPASS MINERALS CANADA", "COMPASS MINERALS"),
    ("AMAZON.COM", "AMAZON"),
    ("T-MOBILE US", "T-MOBILE"),
    ("EUROPE S.A.R.L.", ""),
    ("SAP SE", "SAP"),
    ("AG & CO. KGAA", ""),
    ("S.A.B. DE C.V.", ""),
    ("S.A. DE C.V.", ""),
    ("S.A.R.L.", ""),
    ("S.A.A.", ""),
    ("GS III", ""),
    ("CO.", ""),
    ("COS.", ""),
    ("INC.", ""),
    (" PLC", ""),
    ("CORP.", ""),
    ("LTD.", ""),
    ("COMPANY", ""),
    ("CORPORATION", ""),
    ("S.A.", ""),
    (" LP", ""),
    (" LLC", ""),
    ("INCORPORATED", ""),
    ("INTERNATIONAL", ""),
    ("INFORMATION SERVICES", ""),
    ("PJSC", ""),
    ("N.V.", ""),
    (" NV", ""),
    ("L.P.", ""),
    ("B.V.", ""),
    (" ULC", ""),
    ("GMBH", ""),
    ("GROUP", ""),
    ("HOLDINGS", ""),
    ("OPERATING", ""),
    ("PARTNERS", ""),
    ("(P.H.)", ""),
    ("IRELAND LTD", ""),
    ("JOHNSON (S.C.) & SON", "JOHNSON & JOHNSON"),
    ("CANADA,", ""),
    ("WORLDWIDE", ""),
    ("SYSTEMS", ""),
    ("RESEARCH", ""),
    ("PRODUCTS", ""),
    ("INDUSTRIAL", ""),
    ("TECHNOLOGIES", ""),
    ("TECHNOLOGY", ""),
    ("ENERGY", ""),
    ("ELECTRONICS", ""),
    ("& MANUFACTURING", ""),
    ("INFRASTRUCTURE", ""),
    ("MOTOROLA SOLUTIONS", "MOTOROLA"),
    ("PHARMACEUTICALS", ""),
    ("COMMUNICATIONS", ""),
    ("NETWORKS", ""),
    ("NETWORK", ""),
    ("INGREDIENTS", ""),
    ("CDK GLOBAL", "CDK"),
)
# Endings removed afterwards, in this order.
NAME_ENDINGS = ("INC$", "CORP$", " US$", "LIMITED$", " CO$", " CO LTD$")
# Names whose cleaned form is set by hand.
NAME_OVERRIDES = {
    "PACKAGING CORP. OF AMERICA": "PACKAGING CORP. OF AMERICA",
    "SERVICE CORP. INTERNATIONAL": "SERVICE CORP.",
    "GLOBAL PARTNERS LP": "GLOBAL PARTNERS LP",
}
# Fixed value: accounting term that the recogniser takes for a firm.
NOISE_TERM = "GAAP"


def normalise_name(
    name: Column,
    rules: Sequence[tuple[str, str]] = NAME_RULES,
    endings: Sequence[str] = NAME_ENDINGS,
    overrides: Mapping[str, str] = NAME_OVERRIDES,
) -> Column:
    """Firm name as spoken: upper case, legal forms removed, one closing mark removed."""
    upper = F.upper(name)
    clean = F.trim(replace_chain(upper, rules))
    clean = F.trim(remove_patterns(clean, endings))
    clean = F.regexp_replace(clean, r"[^\w\s]$", "")
    return override(clean, upper, overrides)


def mentions(
    docs: DataFrame,
    names: DataFrame,
    key: str,
    name: str = "name",
    text: str = "text",
) -> DataFrame:
    """Occurrences of each listed name per document.

    Names are split into words as texts are, so marks inside a name do not matter. The list is
    written, so Spark broadcasts it if it is measured to be small. A position of a text that
    starts a name looks as far ahead as the longest name with that first word and no
    further; all names that start there are found.
    """
    listed = names.select(F.upper(name).alias("company_mentioned")).distinct()
    listed = listed.withColumn("_words", words(tokens(F.col("company_mentioned")))).where(F.size("_words") > 0)
    listed = stored(listed.select(
        "company_mentioned", F.concat_ws(" ", "_words").alias("_run"), F.col("_words")[0].alias("_w1"), F.size("_words").alias("_n")), "names")
    starts = stored(listed.groupBy("_w1").agg(F.sort_array(F.collect_set("_n")).alias("_lengths")), "starts")
    longest = listed.agg(F.max("_n")).first()[0] or 1
    upper = F.transform(words(tokens(F.col(text))), lambda w: F.upper(w))
    # A position carries the few words after it, not its text.
    at = [f"_w{i}" for i in range(1, longest + 1)]
    ahead = [F.col("_w"), *[F.slice("_w", i, F.size("_w")) for i in range(2, longest + 1)]]
    positions = docs.select(key, upper.alias("_w")).select(key, F.inline(F.arrays_zip(*ahead))).toDF(key, *at)
    near = positions.join(starts, "_w1").withColumn("_next", F.array(*at))
    run = F.transform("_lengths", lambda n: F.when(F.get("_next", n - 1).isNotNull(), F.array_join(F.slice("_next", F.lit(1), n), " ")))
    hits = near.select(key, F.explode(F.array_compact(run)).alias("_run")).join(listed.select("_run", "company_mentioned"), "_run")
    return hits.groupBy(key, "company_mentioned").agg(F.count("*").alias("n"))


def link_mentions(found: DataFrame, names: DataFrame, panel: DataFrame, key: str) -> DataFrame:
    """Mentions by panel members resolved to other entities; own mentions and noise dropped.

    ``names`` has (matched_key, clean_name); ``found`` has (key, company_mentioned, n).
    """
    members = found.where(F.col("company_mentioned") != NOISE_TERM).join(
        panel.select(key).distinct(), key, "left_semi"
    )
    same = F.col("company_mentioned") == F.col("clean_name")
    return members.join(names, same & (F.col(key) != F.col("matched_key"))).drop("clean_name")


def mention_summary(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: mean mentions and distinct entities per document, with and without zeros."""
    per_doc = found.groupBy(key).agg(
        F.sum("n").alias("mentions"), F.count("*").alias("entities")
    )
    full = docs.select(key).join(per_doc, key, "left").fillna(0, subset=["mentions", "entities"])
    hit = F.col("mentions") > 0
    return full.agg(
        F.count("*").alias("n_docs"),
        F.count_if(hit).alias("n_docs_with"),
        F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("share_with"),
        F.avg("mentions").alias("mean_mentions"),
        F.avg("entities").alias("mean_entities"),
        F.avg(F.when(hit, F.col("mentions"))).alias("mean_mentions_nonzero"),
        F.avg(F.when(hit, F.col("entities"))).alias("mean_entities_nonzero"),
    )
