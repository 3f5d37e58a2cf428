"""How filters interact: what each removes, keeps and repeats in every order they can be applied.

1. ``sift`` reads each text once and sets a bit for each filter that fails on the text alone (A to D).
   Equal texts of one batch of rows meet there: all but those of the batch's least doc_id are
   repeats for certain, so a mass of copies costs one text a batch from here on.
2. The other texts are range-partitioned by a prefix. It is short at first; where texts that
   start alike are too many bytes for one task, they get a prefix four times as long, until they
   fit or the prefix is the text. Equal texts have equal prefixes, so they meet in one task.
3. A task inserts its full texts into a compressed (radix) trie, where a terminal holds the least
   doc_id of its text. The traversal gives each document its mask, with a bit for E if the
   least doc_id is smaller than its own.
4. Masks are counted per part; orders, steps and Shapley sums follow from at most 32 counts a part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import query, stored, table
from .words import SPACE, runs, span_hashes, word_spans

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
MARKS = np.zeros(256, bool)
MARKS[list(b"#$%&*|")] = True
FIRST_PREFIX = 16  # characters
PART_BYTES = 32 << 20  # texts of one trie, with NODE_BYTES for each
NODE_BYTES = 400


def _masks(texts: pa.Array) -> np.ndarray:
    """Bits A to D of each text."""
    out = np.zeros(len(texts), np.int32)
    for first, last, data, offsets in runs(texts):

        def count(flags: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])

        starts, ends, at = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        n = np.diff(at)
        which = np.repeat(np.arange(last - first), n)
        order = np.lexsort((words, which))
        words, which = words[order], which[order]
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]) | (which[1:] != which[:-1])
        different = np.bincount(which[new], minlength=last - first)
        capitals, points = count((data >= 65) & (data <= 90)), count((data & 0xC0) != 0x80)
        out[first:last] = (
            (n < 200) * BIT["A"] + (100 * different < 50 * n) * BIT["B"]
            + (100 * capitals > 3 * points) * BIT["C"] + (count(MARKS[data]) > 0) * BIT["D"])
    return out


SIFTED = "doc_id long, langs array<string>, mask int, text string"


def sift(docs: DataFrame) -> DataFrame:
    """doc_id, langs, mask, text: one row per row of ``docs``, text null where E is settled.

    Settled are rows without doc_id (E does not fail) and those with a smaller doc_id of the same
    text in their batch (E fails). Rows that repeat a text and its least doc_id in the batch are
    one row, langs has the language of each.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            ids, langs, texts = batch.column(0), batch.column(1), pc.fill_null(batch.column(2).cast(pa.large_string()), "")
            masks = _masks(texts)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            values = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            same = texts.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            least = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(least, same[known], values[known])
            repeat = known & (values > least[same])
            masks = masks | np.where(repeat, BIT["E"], 0).astype(np.int32)
            open_ = np.flatnonzero(known & ~repeat)
            order = open_[np.argsort(same[open_], kind="stable")]  # rows of one text are neighbours
            new = np.ones(len(order), bool)
            new[1:] = same[order[1:]] != same[order[:-1]]
            done = np.flatnonzero(~known | repeat)
            take = np.concatenate([done, order])
            starts = np.concatenate([np.arange(len(done)), len(done) + np.flatnonzero(new), [len(take)]]).astype(np.int32)
            rows = take[starts[:-1]]
            text = texts.take(pa.array(rows)) if len(rows) else texts.slice(0, 0)
            open_text = pc.if_else(pa.array(np.arange(len(rows)) >= len(done)), text, pa.scalar(None, pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(starts), langs.take(pa.array(take))),
                 pa.array(masks[rows]), open_text.cast(pa.string())], names=["doc_id", "langs", "mask", "text"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(scan, SIFTED)


def _prefix(length: int) -> Column:
    return F.substring("text", 1, length)


def prefixed(texts: DataFrame, most: int = PART_BYTES) -> DataFrame:
    """The rows with ``prefix``, for each the shortest one whose texts are at most ``most`` bytes together.

    A text that is no longer than its prefix keeps it. The prefixes that are too full are a table
    of at most (all bytes / ``most``) rows for each length; their texts alone go to the next length.
    """
    weight = F.octet_length("text") + NODE_BYTES
    key, length, heavy = _prefix(FIRST_PREFIX), FIRST_PREFIX, []
    rest = texts
    while True:
        full = rest.where(F.length("text") > length).groupBy(_prefix(length).alias(f"prefix_{length}")).agg(F.sum(weight).alias("bytes"))
        full = stored(full.where(F.col("bytes") > most).select(f"prefix_{length}"), "prefixes")
        if full.isEmpty():
            break
        heavy.append((length, full))
        rest = rest.withColumn(f"prefix_{length}", _prefix(length)).join(full, f"prefix_{length}", "left_semi").select("doc_id", "langs", "mask", "text")
        length *= 4
    rows = texts.withColumn("prefix", key)
    for length, full in heavy:  # a hot prefix is a skewed key of an equality join, which Spark splits
        marked = full.select(F.col(f"prefix_{length}").alias("prefix"), F.lit(True).alias("full"))
        rows = rows.join(marked, "prefix", "left")
        rows = rows.withColumn("prefix", F.when(F.col("full"), _prefix(4 * length)).otherwise(F.col("prefix"))).drop("full")
    return rows


class Node:
    """A node of a radix trie: the bytes that lead to it, its children by first byte, what ends here."""

    __slots__ = ("label", "children", "least", "ends")

    def __init__(self, label: bytes):
        self.label, self.children, self.least, self.ends = label, {}, None, None


def _shared(a: bytes, b: bytes, at: int) -> int:
    """How many first bytes of ``a`` stand at ``at`` in ``b``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if b.startswith(a[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def insert(root: Node, text: bytes, doc_id: int, member: tuple) -> None:
    """Put a text into the trie; its terminal keeps the least doc_id and all members."""
    node, at = root, 0
    while at < len(text):
        child = node.children.get(text[at])
        if child is None:
            child = node.children[text[at]] = Node(text[at:])
        elif not text.startswith(child.label, at):
            n = _shared(child.label, text, at)
            middle = Node(child.label[:n])
            child.label = child.label[n:]
            middle.children[child.label[0]] = child
            node.children[text[at]] = child = middle
        node, at = child, at + len(child.label)
    if node.ends is None:
        node.least, node.ends = doc_id, []
    node.least = min(node.least, doc_id)
    node.ends.append((doc_id, *member))


def terminals(root: Node) -> Iterator[tuple[int, list[tuple]]]:
    """Least doc_id and members of every text of the trie."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.ends is not None:
            yield node.least, node.ends
        stack.extend(node.children.values())


VERDICTS = "doc_id long, langs array<string>, mask int"


def duplicates(rows: DataFrame) -> DataFrame:
    """doc_id, langs, mask with bit E, of rows whose equal texts lie in one partition."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = Node(b"")
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for doc_id, langs, mask, text in zip(*columns, batch.column(3).cast(pa.large_binary())):
                insert(root, text.as_py(), doc_id, (langs, mask))
        out: list[tuple] = []
        for least, ends in terminals(root):
            out += [(doc_id, langs, mask | (BIT["E"] if doc_id > least else 0)) for doc_id, langs, mask in ends]
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return rows.select("doc_id", "langs", "mask", "text").mapInArrow(judge, VERDICTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, langs, masks = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(langs, pa.list_(pa.string())), pa.array(masks, pa.int32())], names=["doc_id", "langs", "mask"])


def failures(docs: DataFrame, most: int = PART_BYTES) -> DataFrame:
    """doc_id, lang, mask: the failed filters of each row of ``docs`` (doc_id, text, lang; more are ignored).

    A null text counts as empty. E compares doc_ids: rows of one doc_id do not repeat each other,
    a row without doc_id repeats nothing and is repeated by nothing. An empty table gives none.
    """
    sifted = stored(sift(docs), "sifted")
    texts = sifted.where("text is not null")
    total = texts.agg(F.sum(F.octet_length("text") + NODE_BYTES)).first()[0] or 0
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / most))
    judged = duplicates(prefixed(texts, most).repartitionByRange(parts, "prefix"))
    rows = judged.unionByName(sifted.where("text is null").select("doc_id", "langs", "mask"))
    return rows.select("doc_id", F.explode("langs").alias("lang"), "mask")


def audit(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The report over all orders of the filters, for each part (language).

    rows: doc_id, lang, mask. labels: doc_id, quality, toxic; a doc_id counts as good or toxic if any
    of its rows says so, rows without doc_id have no label, documents without a label are neither.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counts = (
        rows.select("doc_id", "mask", F.coalesce("lang", F.lit("")).alias("part")).join(marks, "doc_id", "left")
        .groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    )
    counts = stored(counts, "masks")  # at most 32 rows for each part
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = counts.select("*", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = F.expr("substring(filter_order, step, 1)")

    def bits(of: Column) -> Column:
        return sum((F.when(F.contains(of, F.lit(x)), F.lit(b)).otherwise(F.lit(0)) for x, b in BIT.items()), F.lit(0))

    before = F.col("mask").bitwiseAND(bits(F.expr("substring(filter_order, 1, step - 1)")))
    own = F.col("mask").bitwiseAND(bits(letter))
    steps = steps.select("*", letter.alias("letter"), (before != 0).alias("gone"), (own != 0).alias("fails"), (F.col("mask") == bits(letter)).alias("only"))

    def total(value: str, when: str) -> Column:
        return F.sum(F.when(F.expr(when), F.coalesce(value, F.lit(0))).otherwise(F.lit(0))).cast("long")

    steps = steps.groupBy("part", "letter", "filter_order", "step").agg(
        total("n", "not gone and not fails").alias("kept"), total("n", "fails and not gone").alias("removed"),
        total("n", "fails and gone").alias("redundant"), total("n", "only").alias("unique_fails"),
        total("good", "fails and not gone").alias("good_lost"), total("toxic", "fails and not gone").alias("toxic_lost"))
    own_orders = Window.partitionBy("part", "letter")  # 120 rows
    return steps.withColumn("shapley", F.sum("removed").over(own_orders)).drop("letter")


@query("op13_interactions", r"""
    with d as (
      select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
             min(doc_id) over (partition by coalesce(text, '')) as least
      from documents),
    f as (
      select doc_id, part,
             case when len(w) < 200 then 1 else 0 end
             + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
             + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 4 else 0 end
             + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
             + case when doc_id > least then 16 else 0 end as mask
      from d),
    l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
    m as (
      select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
      from f left join l using (doc_id) group by part, mask),
    letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as bit),
    orders as (
      select a.x || b.x || c.x || d.x || e.x as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
      from letters a, letters b, letters c, letters d, letters e
      where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
    s as (
      select filter_order, step, bits[step] as own, list_sum(bits[1:step])::int - bits[step] as earlier
      from orders, unnest(range(1, 6)) as t(step)),
    r as (
      select part, filter_order, step::int as step, own,
             sum(case when mask & (own | earlier) = 0 then n else 0 end)::bigint as kept,
             sum(case when mask & own > 0 and mask & earlier = 0 then n else 0 end)::bigint as removed,
             sum(case when mask & own > 0 and mask & earlier > 0 then n else 0 end)::bigint as redundant,
             sum(case when mask = own then n else 0 end)::bigint as unique_fails,
             sum(case when mask & own > 0 and mask & earlier = 0 then good else 0 end)::bigint as good_lost,
             sum(case when mask & own > 0 and mask & earlier = 0 then toxic else 0 end)::bigint as toxic_lost
      from m, s group by part, filter_order, step, own)
    select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) over (partition by part, own))::bigint as shapley
    from r
""")
def op13_interactions(spark, sf_dir):
    """All orders of the five filters over all documents, by language."""
    return audit(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
