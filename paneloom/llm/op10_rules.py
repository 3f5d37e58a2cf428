"""Quality rules as a ledger of failure bits.

``measure`` reads each text once; ``RULES`` turn the measurements into bits of one long, each rule
evaluated once. A policy is a versioned set of rules: a document passes if its failure bits and
the policy's mask have no bit in common. Policies and ablations read the narrow ledger only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .base import query, table
from .words import SPACE, line_spans, runs, span_hashes, word_spans, shingle_hashes

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
# Rules by name, as SQL over the measurements; a rule's place is its bit. Append, never reorder.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "capitals": "10 * n_capitals > 3 * word_chars",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines and n_dup_lines > 2",
    "long_words": "word_chars > 30 * n_words",
}
BASE = ("few_words", "repeated_words")
# Policies by version: the rules that count.
POLICIES = {1: BASE, 2: (*BASE, "symbols", "capitals"), 3: (*BASE, "symbols", "capitals", "repeated_lines", "long_words")}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def mask(rules: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    return sum(1 << list(RULES).index(name) for name in rules)


def _repeats(words: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which the text has twice or more."""
    if len(words) <= width:
        return 0
    windows = shingle_hashes(words, width)
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i: len(windows) + i] |= twice
    return int(covered.sum())


def measure(docs: DataFrame) -> DataFrame:
    r"""doc_id and the measurements (long) of every whole text; a null text counts as empty.

    n_words, word_chars: words ``[^\x20\x09-\x0D]+`` and the code points in them. n_symbols: characters
    of ``[#*$%&|<>]``. n_lines: \n-split lines with a word; n_dup_lines: those equal to an earlier
    line. n_repeat_words: words in 3-word windows found twice or more. n_capitals: A to Z.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((len(MEASURES), len(batch)), np.int64)
            for first, last, data, offsets in runs(batch.column(1)):
                starts, ends, at = word_spans(data, offsets)
                words = span_hashes(data, starts, ends)

                def count(flags: np.ndarray) -> np.ndarray:
                    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])

                out[0, first:last] = np.diff(at)
                out[1, first:last] = count(~SPACE[data] & ((data & 0xC0) != 0x80))
                out[2, first:last] = count(SYMBOLS[data])
                out[6, first:last] = count((data >= 65) & (data <= 90))
                begin, end, lines_at = line_spans(data, offsets)
                worded = np.searchsorted(starts, begin) < np.searchsorted(starts, end)
                lines = span_hashes(data, begin, end)
                for i in range(last - first):
                    own = slice(lines_at[i], lines_at[i + 1])
                    held = lines[own][worded[own]]
                    out[3, first + i] = len(held) - len(np.unique(held)) if len(held) > 1 else 0
                    out[4, first + i] = _repeats(words[at[i]: at[i + 1]])
                    out[5, first + i] = len(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["doc_id", *MEASURES])

    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, schema)


def ledger(docs: DataFrame) -> DataFrame:
    """``measure`` and failed_rules, one bit for each failed rule.

    One row per row of ``docs`` (doc_id, text; more columns are ignored): null ids and repeated
    rows stay, a null, empty or wordless text fails few_words, an empty table gives none.
    """
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measure(docs).withColumn("failed_rules", total)


def passes(version: int) -> Column:
    """Whether a row of the ledger passes the policy of this version."""
    return F.col("failed_rules").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0


def ablations(rows: DataFrame, version: int) -> DataFrame:
    """rule, failed, only, kept_without for each rule of a policy, from one count of bit patterns.

    failed: documents that fail the rule; only: fail no other rule of the policy; kept_without:
    documents that the policy would keep if the rule were left out.
    """
    own = mask(POLICIES[version])
    spark = rows.sparkSession
    patterns = rows.groupBy(F.col("failed_rules").bitwiseAND(F.lit(own).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = spark.createDataFrame([(name, mask((name,))) for name in POLICIES[version]], "rule string, bit long")
    pairs = patterns.join(F.broadcast(rules))  # at most 2^rules patterns times a handful of rules
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    only = F.col("bits") == F.col("bit")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias
    return pairs.groupBy("rule").agg(
        total(has)("failed"), total(only)("only"), total(only | (F.col("bits") == 0))("kept_without"))


@query("op10_rules", r"""
    with d as (
      select row_number() over () as k, doc_id, coalesce(text, '') as text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
      from documents),
    windows as (
      select k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s
      from (select k, w, unnest(range(1, len(w) - 1)) as i from d where len(w) > 2)),
    twice as (select k, i from (select k, i, count(*) over (partition by k, s) as c from windows) where c > 1),
    covered as (
      select k, count(distinct j) as n
      from (select k, i as j from twice union all select k, i + 1 from twice union all select k, i + 2 from twice) group by k),
    lines as (
      select k, count(*) as n, count(*) - count(distinct l) as dup
      from (select k, unnest(string_split(text, chr(10))) as l from d)
      where regexp_matches(l, '[^\x20\x09-\x0D]') group by k),
    m as (
      select doc_id, len(w)::bigint as n_words,
             coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             coalesce(lines.dup, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
             coalesce(lines.n, 0)::bigint as n_lines,
             length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint as n_capitals
      from d left join lines using (k) left join covered using (k)),
    f as (
      select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
             case when n_words < 50 then 1 else 0 end
             + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
             + case when 10 * n_symbols > 3 * n_words then 4 else 0 end
             + case when 10 * n_capitals > 3 * word_chars then 8 else 0 end
             + case when 10 * n_dup_lines > 3 * n_lines and n_dup_lines > 2 then 16 else 0 end
             + case when word_chars > 30 * n_words then 32 else 0 end as failed_rules
      from m)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           failed_rules & 15 = 0 as kept, failed_rules::bigint as failed_rules
    from f
""")
def op10_rules(spark, sf_dir):
    """The ledger of all documents under policy 2."""
    rows = ledger(table(spark, sf_dir, "documents"))
    base = F.col("failed_rules").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), passes(2).alias("kept"), "failed_rules")
