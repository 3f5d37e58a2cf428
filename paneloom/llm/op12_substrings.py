"""Removal of passages that an earlier document holds, by automata of the repeated phrases.

1. Anchors: of every window of ``WINDOW`` words, the ``ANCHOR``-word shingle of least hash. Equal
   windows have equal anchors, and about a fifth of all places is one. Anchors found in two different
   texts or more can lie in repeated windows, no others.
2. Each different text (the smallest doc_id stands for its copies) is cut into phrases at such
   anchors: the words of all windows in a row that share the anchor. Equal phrases are one
   row with the smallest and largest document that holds them.
3. Phrases are dealt to shards by their anchor. A task confirms which windows of a shard recur in
   different documents, word by word, compiles them into an Aho-Corasick automaton over word
   numbers whose values are the smallest documents, and streams all phrases through it.
   An anchor of more than ``HEAVY`` texts is dealt by whole windows instead, so no shard fills up.
4. The hits return to the documents through the phrases' hashes; a document's covered words
   are the union of its windows that a smaller document holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import query, stored, table
from .words import M3, SPACE, mix, runs, span_hashes, word_spans

WINDOW, ANCHOR = 13, 5
HEAVY = 10_000  # texts; an anchor found in more is dealt by windows
SHARD_PHRASES = 20_000  # phrases of an automaton, about
LONGEST = 64  # windows of a phrase; a longer row of windows is cut


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on; the last places have none."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, np.uint64(size), np.uint64)
    for i in range(size if n else 0):
        out = mix(out * M3 + words[i: n + i])
    return out


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of the ``size`` values from each place on."""
    span = 1
    while 2 * span <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    more = size - span
    return np.minimum(values[: len(values) - more], values[more:]) if more else values


class Stretch:
    """Texts of a run: their words joined by one space, and the anchor of every window."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.at = word_spans(data, offsets)
        self.hashes = span_hashes(data, starts, ends)
        keep = ~SPACE[data]
        data = data.copy()
        inner = np.ones(len(starts), bool)  # words that another of their text follows
        inner[self.at[1:][self.at[1:] > 0] - 1] = False
        keep[ends[inner]] = True
        data[ends[inner]] = 0x20
        self.bytes = data[keep].tobytes()
        lengths = ends - starts
        gaps = np.concatenate([[0], np.cumsum(lengths + inner)])
        self.first, self.last = gaps[:-1], gaps[:-1] + lengths
        least = np.zeros(len(starts), np.uint64)
        if len(starts) >= WINDOW:
            found = sliding_least(window_hashes(self.hashes, ANCHOR), WINDOW - ANCHOR + 1)
            least[: len(found)] = found
        self.anchors = least.view(np.int64)

    def words(self, first: int, last: int) -> bytes:
        """The words ``first`` to ``last - 1``, joined by one space."""
        return self.bytes[self.first[first]: self.last[last - 1]] if last > first else b""


SCANNED = "doc_id long, node long, twin long, n_words long, whole string, anchors array<long>"


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, node and twin (128 bits of the text's hash), text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), F.xxhash64(F.lit(12), text).alias("twin"), text.alias("text"))


def scan(docs: DataFrame) -> DataFrame:
    """Of each row: number of words, hash of all words, its different anchors."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, wholes, found, at = [], [], [], [0]
            for first, last, data, offsets in runs(batch.column(3)):
                s = Stretch(data, offsets)
                for i in range(last - first):
                    a, b = s.at[i], s.at[i + 1]
                    counts.append(int(b - a))
                    wholes.append(hashlib.sha256(s.words(a, b)).hexdigest())
                    own = np.unique(s.anchors[a: max(a, b - WINDOW + 1)])
                    found.append(own)
                    at.append(at[-1] + len(own))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(counts, pa.int64()), pa.array(wholes, pa.string()), lists],
                names=["doc_id", "node", "twin", "n_words", "whole", "anchors"])

    return _named(docs).mapInArrow(read, SCANNED)


PHRASES = "family long, words string, doc_id long, node long, twin long, place int"


def phrases(texts: DataFrame) -> DataFrame:
    """The phrases of each text at its repeated anchors (texts: doc_id, node, twin, text, anchors, heavy)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in range(3)]
            lists, heavies = batch.column(4), batch.column(5)
            for first, last, data, offsets in runs(batch.column(3)):
                s = Stretch(data, offsets)
                whole = window_hashes(s.hashes, WINDOW)
                rows: list[tuple] = []
                for i in range(last - first):
                    a, b = int(s.at[i]), int(s.at[i + 1])
                    if b - a < WINDOW:
                        continue
                    n = b - a - WINDOW + 1
                    anchors = s.anchors[a: a + n]
                    wanted = np.sort(lists[first + i].values.to_numpy())
                    near = np.minimum(np.searchsorted(wanted, anchors), len(wanted) - 1)
                    hit = wanted[near] == anchors
                    single = np.zeros(n, bool)
                    heavy = heavies[first + i].values
                    if len(heavy):
                        single = hit & np.isin(anchors, heavy.to_numpy())
                    begins = hit & single
                    begins[0] |= hit[0]
                    begins[1:] |= hit[1:] & (anchors[1:] != anchors[:-1])
                    stops = np.flatnonzero(begins | ~hit)
                    key = [x[first + i] for x in ids]
                    for p in np.flatnonzero(begins):
                        nxt = np.searchsorted(stops, p, "right")
                        end = int(stops[nxt]) if nxt < len(stops) else n
                        for q in range(int(p), end, LONGEST):
                            upto = min(end, q + LONGEST)
                            family = anchors[q] if not single[q] else whole[a + q].view(np.int64)
                            rows.append((int(family), s.words(a + q, a + upto + WINDOW - 1), *key, q))
                if rows:
                    yield _phrase_batch(rows)

    rows = texts.select("doc_id", "node", "twin", "text", "anchors", "heavy")
    return rows.mapInArrow(cut, PHRASES)


def _phrase_batch(rows: list[tuple]) -> pa.RecordBatch:
    family, words, doc_id, node, twin, place = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(family, pa.int64()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(doc_id, pa.int64()),
         pa.array(node, pa.int64()), pa.array(twin, pa.int64()), pa.array(place, pa.int32())],
        names=["family", "words", "doc_id", "node", "twin", "place"])


def automaton(sequences: list[tuple[int, ...]], low: list[int], high: list[int]):
    """Aho-Corasick automaton of the windows of different documents, each with its smallest; None without any."""
    windows: dict[tuple[int, ...], tuple[int, int]] = {}
    for sequence, a, b in zip(sequences, low, high):
        for i in range(len(sequence) - WINDOW + 1):
            window = sequence[i: i + WINDOW]
            seen = windows.get(window)
            windows[window] = (a, b) if seen is None else (min(a, seen[0]), max(b, seen[1]))
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, (a, b) in windows.items():
        if a < b:
            found.add_word(window, a)
    if not len(found):
        return None
    found.make_automaton()
    return found


LOCATED = "family long, hash long, lows array<long>"


def locate(distinct: DataFrame, shards: int) -> DataFrame:
    """family, hash, lows: of each phrase with a repeated window, the smallest document of every window (null: none smaller).

    distinct: family, words, low, high. The largest document of a phrase decides whether a window counts here.
    """

    def stream(key: tuple, rows: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        sequences = []
        for words in rows.column("words").cast(pa.binary()).to_pylist():
            sequences.append(tuple([numbers.setdefault(w, len(numbers) + 1) for w in words.split(b" ")]))
        low, high = rows.column("low").to_pylist(), rows.column("high").to_pylist()
        found = automaton(sequences, low, high)
        at, lows = [], []
        for i, sequence in enumerate(sequences if found else ()):
            own = [None] * (len(sequence) - WINDOW + 1)
            some = False
            for end, least in found.iter(sequence):
                if least < high[i]:
                    own[end - WINDOW + 1] = least
                    some = True
            if some:
                at.append(i)
                lows.append(own)
        chosen = rows.select(["family", "hash"]).take(pa.array(at, pa.int64()))
        return chosen.append_column("lows", pa.array(lows, pa.list_(pa.int64())))

    rows = distinct.select(
        F.pmod(F.xxhash64("family"), F.lit(shards)).alias("shard"), "family", F.xxhash64("words").alias("hash"), "words", "low", "high")
    return rows.groupBy("shard").applyInArrow(stream, LOCATED)


def kept_words(texts: DataFrame) -> DataFrame:
    """node, twin, n_removed, kept_sha256 of each text with the first words of its covered windows (starts)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests = [], []
            for text, starts in zip(batch.column(2).cast(pa.large_binary()), batch.column(3)):
                words = text.as_py().translate(_BLANK).split()
                edges = np.zeros(len(words) + 1, np.int64)
                first = np.unique(starts.values.to_numpy())
                edges[first] += 1
                np.subtract.at(edges, first + WINDOW, 1)
                covered = np.cumsum(edges[:-1]) > 0
                removed.append(int(covered.sum()))
                digests.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~covered)])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                names=["node", "twin", "n_removed", "kept"])

    return texts.select("node", "twin", "text", "starts").mapInArrow(judge, "node long, twin long, n_removed long, kept string")


_BLANK = bytes(0x20 if SPACE[b] else b for b in range(256))


def without_repeats(docs: DataFrame, heavy: int = HEAVY, shard_phrases: int = SHARD_PHRASES) -> DataFrame:
    r"""doc_id, n_words, n_removed, kept_sha256 of every row of ``docs`` (doc_id, text; more columns are ignored).

    Words are ``[^\x20\x09-\x0D]+``; those of a window of 13 that starts in a document of smaller doc_id
    are removed, all windows being judged on the input. A null or wordless text has no words, and the
    hash of nothing. Rows of one doc_id, equal or not, do not remove each other's words; a row without
    doc_id loses none and removes none. An empty table gives an empty result.
    """
    scanned = stored(scan(docs), "scanned")
    ours = scanned.where("doc_id is not null")
    classes = stored(ours.groupBy("node", "twin").agg(F.min("doc_id").alias("rep")), "classes")
    places = ours.select("node", F.explode("anchors").alias("anchor"))
    repeated = places.groupBy("anchor").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"))
    repeated = stored(repeated.where("low < high").select("anchor", (F.col("n") > heavy).alias("is_heavy")), "anchors")
    lists = places.join(repeated, "anchor").groupBy("node").agg(
        F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("is_heavy"), F.col("anchor"))).alias("heavy"))
    wanted = stored(lists.join(classes, "node"), "wanted")  # no more anchors than the text has words

    texts = _named(docs.where("doc_id is not null"))
    chosen = texts.join(wanted, ["node", "twin"]).where("doc_id = rep")
    cut = stored(phrases(chosen), "phrases")
    shards = max(1, math.ceil(cut.count() / shard_phrases))
    located = locate(cut.groupBy("family", "words").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), shards)
    located = stored(located, "located")

    hits = cut.select("family", F.xxhash64("words").alias("hash"), "doc_id", "node", "twin", "place").join(located, ["family", "hash"])
    hits = hits.select("doc_id", "node", "twin", F.expr(
        "filter(transform(lows, (low, i) -> if(low < doc_id, place + i, null)), x -> x is not null)").alias("starts")).where("size(starts) > 0")
    covered = hits.groupBy("node", "twin", F.col("doc_id").alias("rep")).agg(F.flatten(F.collect_list("starts")).alias("starts"))
    covered = stored(covered, "covered")
    judged = kept_words(texts.join(covered, ["node", "twin"]).where("doc_id = rep"))
    judged = classes.join(judged.dropDuplicates(["node", "twin"]), ["node", "twin"], "left")

    rows = scanned.select("doc_id", "node", "twin", "n_words", "whole").join(judged, ["node", "twin"], "left")
    copy = F.coalesce((F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= WINDOW), F.lit(False))
    own = F.col("doc_id").isNotNull()
    return rows.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(own, F.coalesce("kept", "whole")).otherwise(F.col("whole")).alias("kept_sha256"))


@query("op12_substrings", r"""
    with d as (
      select row_number() over () as k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
      from documents),
    s as (
      select k, doc_id, i, array_to_string(w[i:i + 12], ' ') as s
      from (select k, doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
    r as (select k, i from (select k, i, doc_id, min(doc_id) over (partition by s) as low from s) where low < doc_id),
    c as (select distinct k, j from (select k, unnest(range(i, i + 13)) as j from r)),
    v as (select k, list(j) as gone, count(*) as n from c group by k)
    select doc_id, len(w)::bigint as n_words, coalesce(v.n, 0)::bigint as n_removed,
           sha256(array_to_string(
             case when v.n is null then w else list_filter(w, lambda x, j: not list_contains(gone, j)) end, ' ')) as kept_sha256
    from d left join v using (k)
""")
def op12_substrings(spark, sf_dir):
    """What is left of all documents without passages of smaller ones."""
    return without_repeats(table(spark, sf_dir, "documents"))
