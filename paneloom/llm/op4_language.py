"""Language identification by prediction by partial matching.

Each language has a byte context tree of order 3: in a context, a byte seen there costs
count / (all + distinct), an unseen one the escape distinct / (all + distinct) and then what the
next shorter context gives it, with the bytes of the longer contexts excluded; below order 0 all
256 bytes are alike. The counts are frozen after learning, so the code length of a byte depends on
the three bytes before it only: all lengths are worked out once per context, and a text is scored
by one lookup per byte. The language of the shortest code wins.

Learning takes a sample of about ``TRAIN_DOCS`` labelled texts of each of the ``LANGUAGES`` most
frequent languages; the model keeps the ``CONTEXTS`` most frequent contexts of three bytes
and is bounded by that, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .base import query, table
from .words import runs

ORDER = 3
TRAIN_DOCS = 1500  # labelled texts of a language that are learned from, about
LANGUAGES = 200  # that are learned, the most frequent ones
CONTEXTS = 16_000  # contexts of three bytes that the model keeps
SLICE = 1 << 18  # bytes that are scored at once
UNKNOWN = "und"
PAD = 0x20  # a text is read as if spaces stood before it


@dataclass
class Model:
    """Frozen code lengths: ``cost[state * width + symbol]`` has the bits in each language."""

    languages: list[str]
    symbol: np.ndarray  # byte -> symbol, 0 for bytes never seen
    state: np.ndarray  # three symbols -> state
    cost: np.ndarray


def _contexts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The three bytes (or symbols) before each place, farthest first; padding before a text's start."""
    out = []
    for back in range(ORDER, 0, -1):
        shifted = np.concatenate([np.full(back, data.dtype.type(0)), data[:-back]])[: len(data)]
        for k in range(back):
            at = offsets[:-1] + k
            at = at[at < np.minimum(offsets[1:], len(data))]
            shifted[at] = PAD
        out.append(shifted)
    return out


def sample(docs: DataFrame, per_language: int = TRAIN_DOCS, languages: int = LANGUAGES) -> DataFrame:
    """lang, text of about ``per_language`` rows of each of the most frequent languages, drawn by a hash of doc_id.

    The rows of each language are counted first; the shares then are part of the scan's filter,
    so only drawn texts leave it.
    """
    known = docs.where("lang is not null and text is not null")
    top = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    chance = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 32)) / float(1 << 32)
    shares = F.create_map(*[F.lit(x) for r in top for x in (r["lang"], per_language / r["n"])]) if top else F.lit(None).cast("map<string,double>")
    return known.where(chance < F.try_element_at(shares, F.col("lang"))).select("lang", "text")


def gram_counts(texts: DataFrame) -> DataFrame:
    """lang, gram (four bytes as one number), n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            codes = langs.indices.to_numpy(zero_copy_only=False)
            names = langs.dictionary
            for first, last, data, offsets in runs(batch.column(1)):
                if not len(data):
                    continue
                gram = data.astype(np.uint64)
                for k, before in enumerate(_contexts(data, offsets)):
                    gram |= before.astype(np.uint64) << np.uint64(8 * (ORDER - k))
                gram |= np.repeat(codes[first:last], np.diff(offsets)).astype(np.uint64) << np.uint64(32)
                value, n = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array((value >> np.uint64(32)).astype(np.int64))),
                     pa.array((value & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"])

    found = texts.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, per_language: int = TRAIN_DOCS, contexts: int = CONTEXTS) -> Model:
    """The model of labelled rows (doc_id, lang, text); without any, one that knows no language."""
    counts = gram_counts(sample(docs, per_language)).toArrow()
    names = counts.column("lang").to_pylist()
    languages = sorted(set(names))
    place = {name: i for i, name in enumerate(languages)}
    lang = np.fromiter((place[n] for n in names), np.int64, len(names))
    gram, n = (counts.column(c).to_numpy().astype(np.int64) for c in ("gram", "n"))
    grams = np.stack([(gram >> (8 * k)) & 255 for k in range(ORDER, -1, -1)])  # farthest byte first, the coded one last
    seen = np.union1d(np.unique(grams[ORDER]), [PAD])
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    grams = symbol[grams]

    # States: the contexts kept of each order, and the root. Tables lead from symbols to the longest kept context.
    states: list[tuple[int, ...]] = [()]
    levels = np.zeros(1, np.int32)
    for order in range(1, ORDER + 1):
        code = np.zeros(len(gram), np.int64)
        for k in range(ORDER - order, ORDER):
            code = code * width + grams[k]
        value, where = np.unique(code, return_inverse=True)
        total = np.bincount(where, n) if len(value) else np.zeros(0)
        if order == ORDER and len(value) > contexts:
            value = np.sort(value[np.argsort(-total, kind="stable")[:contexts]])
        longer = np.tile(levels, width)  # an unseen context falls back to the one without its farthest symbol
        longer[value] = np.arange(len(states), len(states) + len(value))
        for v in value:
            states.append(tuple(int(v) // width**k % width for k in range(order - 1, -1, -1)))
        levels = longer

    cost = np.zeros((len(states), width, len(languages)), np.float32)
    lengths = np.array([len(s) for s in states])
    for i in range(len(languages)):
        own = lang == i
        tables = []  # of each order: count of symbol after context, dense over the kept contexts
        for order in range(ORDER + 1):
            code = np.zeros(own.sum(), np.int64)
            for k in range(ORDER - order, ORDER):
                code = code * width + grams[k][own]
            tables.append((code * width + grams[ORDER][own], n[own]))
        for order in range(ORDER + 1):
            mine = np.flatnonzero(lengths == order)
            bits = np.zeros((len(mine), width))
            excluded = np.zeros((len(mine), width), bool)
            spent = np.zeros(len(mine))  # bits of the escapes so far
            for shorter in range(order, -1, -1):
                code = np.array([_number(states[m][order - shorter:], width) for m in mine], np.int64)
                kept, back = np.unique(code, return_inverse=True)
                key, weight = tables[shorter]
                context, last = key // width, key % width
                at = np.searchsorted(kept, context)
                hit = (at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == context)
                dense = np.zeros((len(kept), width))
                np.add.at(dense, (at[hit], last[hit]), weight[hit])
                here = np.where(excluded, 0, dense[back])
                total, distinct = here.sum(1), (here > 0).sum(1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    own_bits = spent[:, None] - np.log2(here / (total + distinct)[:, None])
                    escape = -np.log2(distinct / (total + distinct))
                bits = np.where(here > 0, own_bits, bits)
                excluded |= here > 0
                spent += np.where(distinct > 0, escape, 0)
            rest = spent + np.log2(256 - excluded.sum(1))
            bits = np.where(excluded, bits, rest[:, None])
            cost[mine, :, i] = bits
    return Model(languages, symbol, levels, cost.reshape(-1, max(len(languages), 1)) if languages else cost)


def _number(symbols: tuple[int, ...], width: int) -> int:
    value = 0
    for s in symbols:
        value = value * width + s
    return value


def code_lengths(model: Model, texts: pa.Array) -> np.ndarray:
    """Bits of each whole text in each language."""
    width = int(round(len(model.state) ** (1 / ORDER)))
    pad = model.symbol[PAD]
    out = np.zeros((len(texts), len(model.languages)))
    for first, last, data, offsets in runs(texts):
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            continue
        symbols = model.symbol[data]
        index = np.zeros(len(data), np.int32)
        for before in range(ORDER, 0, -1):
            shifted = np.empty_like(symbols)
            shifted[:before] = pad
            shifted[before:] = symbols[:-before]
            for k in range(before):
                at = offsets[full] + k
                shifted[at[at < offsets[full + 1]]] = pad
            index *= width
            index += shifted
        starts = offsets[full]
        for a in range(0, len(data), SLICE):  # a float for each language and byte of a slice
            b = min(len(data), a + SLICE)
            costs = model.cost[model.state[index[a:b]] * width + symbols[a:b]]
            i, j = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b))
            out[first + full[i:j]] += np.add.reduceat(costs, np.maximum(starts[i:j], a) - a, axis=0, dtype=np.float64)
    return out


def identify(docs: DataFrame, model: Model, row: Column, text_in_row: bool = False) -> DataFrame:
    """row, lang_pred, score, bits_per_byte of every row of ``docs``; only the text is read.

    ``text_in_row``: ``row`` is a struct with the field ``text``, which then goes to the tasks once.

    lang_pred is ``und`` with score 0 if the text is null or has no letter, or if the model knows no
    language. score is the share of the best language if all were as likely beforehand; a tie goes
    to the smaller name. bits_per_byte: best code length over the text's bytes (0 for ``und``).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    text = F.col("text").cast("string")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    rows = docs.select(row.alias("row"), lettered, *([] if text_in_row else [text.alias("text")]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = pa.array([*known.languages, UNKNOWN], pa.string())
        for batch in batches:
            may = batch.column(1).to_numpy(zero_copy_only=False).astype(bool) & (len(known.languages) > 0)
            best = np.full(len(batch), len(known.languages))
            score, per_byte = np.zeros(len(batch)), np.zeros(len(batch))
            if may.any():
                texts = pc.struct_field(batch.column(0), "text").cast(pa.string()) if text_in_row else batch.column(2)
                texts = texts.filter(pa.array(may))
                bits = code_lengths(known, texts)
                least = bits.min(1)
                best[may] = bits.argmin(1)
                score[may] = 1 / np.exp2(least[:, None] - bits).sum(1)
                per_byte[may] = least / np.array([len(t.as_buffer()) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), names.take(pa.array(best)), pa.array(score), pa.array(per_byte)],
                names=["row", "lang_pred", "score", "bits_per_byte"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(predict, f"row {kind}, lang_pred string, score double, bits_per_byte double")


def held_out() -> Column:
    """Whether a row is never learned from: crc32 of doc_id as text is divisible by 5, or doc_id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learned(docs: DataFrame) -> Model:
    """The model of the rows of ``docs`` that are not held out."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"))
    return learn(rows.where(~held_out()))


@query("op4_language")
def op4_language(spark, sf_dir):
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"))
    return identify(docs, learned(docs), row).select("row.doc_id", "row.held_out", "lang_pred", "score")
