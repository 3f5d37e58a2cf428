"""How the sources of a language differ in their words, counted through minimal perfect hashes.

1. Exact document frequencies keep the terms of a language that enough of its documents hold.
2. The kept terms of a language are cut into shards of about ``SHARD_KEYS`` by a hash. A task
   builds the minimal perfect hash of a shard: levels of bits, where a key that lands alone in
   a level sets its bit and the others go on to the next; a key's index is the rank of its bit.
   The keys are stored in index order, so that a lookup ends with a comparison of the whole key.
3. Shards are broadcast in waves of at most ``WAVE_BYTES``. For each wave a second pass over all
   documents looks up the distinct terms of a stretch of text and increments dense slots, an
   array for each (lang, source) and shard. They leave a task when they reach ``SLOT_BYTES`` and at
   its end, as lists of the slots above zero, a row for each block of slots, and are added up
   block by block, again in dense slots.
4. A block is a matrix of sources by terms, whose size is bounded for any number of sources. There
   shares p are worked out as exact integers (a source that lacks a term has its least share), the
   sources are compared pairwise, and each source's most divergent terms are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import query, stored, table
from .words import LOWER, M3, mix, runs, span_hashes, text_bytes, word_spans

LEAST_DOCS = 3
TOP = 200  # ranks reported of a group's terms
SHARD_KEYS = 1 << 15
WAVE_BYTES = 48 << 20  # of keys and bits broadcast at once
SLOT_BYTES = 96 << 20  # of slots in a task
BLOCK = 1 << 18  # cells in the matrix of one block of terms
RUN = 4 << 20
LEVELS = 24
SALTS = mix(np.arange(1, LEVELS + 1, dtype=np.uint64) * M3)
UNIT = 1_000_000_000
OUTSIDE = np.ones(256, bool)  # bytes that belong to no term
OUTSIDE[0x41:0x5B] = OUTSIDE[0x61:0x7B] = OUTSIDE[0x80:] = False


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary array of values of these lengths that lie one after another in ``data``."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _stretches(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """(first, last, text of each term, its code, the different terms) of stretches of the texts."""
    for first, last, data, offsets in runs(texts, RUN):
        data = LOWER[data]
        starts, ends, at = word_spans(data, offsets, OUTSIDE)
        if len(starts):
            coded = _strings(data[~OUTSIDE[data]], ends - starts).dictionary_encode()
            yield first, last, np.repeat(np.arange(first, last), np.diff(at)), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = pc.fill_null(column.cast(pa.string()), "").dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, in any order, and how often each occurs."""
    found = pc.value_counts(pa.array(values))
    return found.field("values").to_numpy(), found.field("counts").to_numpy()


def frequencies(docs: DataFrame) -> DataFrame:
    """lang, term (binary, UTF-8), docs: partial numbers of documents with the term; sum them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, names = _codes(batch.column(0))
            for _, _, doc, code, terms in _stretches(batch.column(1)):
                pairs = pc.unique(pa.array(doc * len(terms) + code)).to_numpy()
                pairs, n = _counted(langs[pairs // len(terms)] * len(terms) + pairs % len(terms))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(pairs // len(terms))), terms.take(pa.array(pairs % len(terms))).cast(pa.binary()), pa.array(n)],
                    names=["lang", "term", "docs"])

    return docs.select("lang", F.col("text").cast("string")).mapInArrow(scan, "lang string, term binary, docs long")


# -- minimal perfect hashes -------------------------------------------------------------------

def _hashes(keys: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(keys)
    return span_hashes(data, offsets[:-1], offsets[1:])


def _place(hashes: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    return (mix(hashes + SALTS[level]) % np.asarray(size, np.uint64)).astype(np.int64)


def perfect_hash(hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The bits of each level, and the index of each key, a permutation of 0 to n - 1.

    Keys that are left after ``LEVELS`` levels (equal hashes) get the last indexes.
    """
    index = np.zeros(len(hashes), np.int64)
    left, levels, before = np.arange(len(hashes)), [], 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = 2 * len(left) + 1
        at = _place(hashes[left], level, size)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        index[left[alone]] = before + (np.cumsum(bits) - 1)[at[alone]]
        before += int(bits.sum())
        levels.append(bits)
        left = left[~alone]
    index[left] = before + np.arange(len(left))
    return levels, index


SHARDS = "lang string, shard int, n long, n_levels int, sizes array<long>, bits binary, lengths binary, keys binary, size long"


def shards(kept: DataFrame) -> DataFrame:
    """One row for each shard of the kept terms (lang, term): its levels, and its keys by index."""
    parts = stored(kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD_KEYS).cast("int").alias("parts")), "parts")

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        terms = rows.column("term").combine_chunks().cast(pa.large_binary())
        levels, index = perfect_hash(_hashes(terms))
        terms = terms.take(pa.array(np.argsort(index)))
        data, offsets = text_bytes(terms)
        bits = np.packbits(np.concatenate(levels)).tobytes() if levels else b""
        lengths = np.diff(offsets).astype(np.int32).tobytes()
        return pa.table({
            "lang": [key[0].as_py()], "shard": pa.array([key[1].as_py()], pa.int32()), "n": [len(terms)], "n_levels": pa.array([len(levels)], pa.int32()),
            "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary()),
            "lengths": pa.array([lengths], pa.binary()), "keys": pa.array([data.tobytes()], pa.binary()),
            "size": [len(bits) + len(lengths) + len(data)]})

    rows = kept.join(parts, "lang").select("lang", "term", shard_of(F.col("term"), F.col("parts")).alias("shard"))
    return rows.groupBy("lang", "shard").applyInArrow(build, SHARDS)


def shard_of(term: Column, parts: Column) -> Column:
    """The shard of a term, from the CRC-32 that tasks can compute as well."""
    return F.pmod(F.crc32(term), parts).cast("int")


class Hashes:
    """The shards of a wave, ready for lookups: (lang, number of its shards) -> shards by number."""

    def __init__(self, rows: list[dict], parts: dict[str, int]):
        self.parts, self.shards = parts, {}
        for r in rows:
            bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)[: sum(r["sizes"])]
            ends = np.cumsum(r["sizes"]).astype(np.int64)
            levels = [(bits[e - s: e], np.cumsum(bits[e - s: e], dtype=np.int32)) for e, s in zip(ends, r["sizes"])]
            keys = _strings(np.frombuffer(r["keys"], np.uint8), np.frombuffer(r["lengths"], np.int32))
            self.shards[r["lang"], r["shard"]] = (r["n"], levels, keys)

    def find(self, lang: str, shard: int, terms: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Index of each term in the shard, -1 for terms that it does not hold."""
        n, levels, keys = self.shards[lang, shard]
        out = np.full(len(terms), -1, np.int64)
        left, before = np.arange(len(terms)), 0
        for level, (bits, ranks) in enumerate(levels):
            at = _place(hashes[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = before + ranks[at[hit]] - 1
            before += int(ranks[-1])
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        same = pc.equal(keys.take(pa.array(out[found])), terms.take(pa.array(found))).to_numpy(zero_copy_only=False)
        out[found[~same]] = -1
        if before < n:  # keys without a level of their own; one of them may share the hash of a key with one
            rest = {k.as_py(): before + i for i, k in enumerate(keys.slice(before))}
            for i in np.flatnonzero(out < 0):
                out[i] = rest.get(terms[i].as_py(), -1)
        return out


def _crc32(terms: pa.Array) -> np.ndarray:
    from zlib import crc32

    return np.fromiter((crc32(t) for t in terms.to_pylist()), np.int64, len(terms))


COUNTS = "lang string, source string, shard int, part int, slots binary, n binary"


def recount(docs: DataFrame, built: DataFrame, sources: DataFrame) -> DataFrame:
    """lang, source, shard, part, slots, n, total: occurrences of the kept terms in every group that has any.

    sources: lang, n_sources. A part is a block of ``width`` slots of a shard, so that a matrix of all
    sources of the language has about ``BLOCK`` cells. total: sum of n.
    """
    spark = docs.sparkSession
    # A short row for each SHARD_KEYS terms.
    plan = built.select("lang", "shard", "size").join(sources, "lang").orderBy("lang", "shard").collect()
    parts: dict[str, int] = {}
    widths: dict[str, int] = {}
    for r in plan:
        parts[r["lang"]] = max(parts.get(r["lang"], 0), r["shard"] + 1)
        widths[r["lang"]] = block_width(r["n_sources"])
    waves: list[list] = []
    room = 0
    for r in plan:
        if not waves or r["size"] > room:
            waves.append([])
            room = WAVE_BYTES
        waves[-1].append((r["lang"], r["shard"]))
        room -= r["size"]
    rows = docs.select("lang", "source", F.col("text").cast("string"))
    out = None
    for wave in waves:
        (low, high), langs = (wave[0], wave[-1]), sorted({x[0] for x in wave})
        chosen = built.where(
            F.col("lang").isin(langs) & (F.struct("lang", "shard") >= F.struct(F.lit(low[0]), F.lit(low[1]).cast("int")))
            & (F.struct("lang", "shard") <= F.struct(F.lit(high[0]), F.lit(high[1]).cast("int"))))
        sent = spark.sparkContext.broadcast([r.asDict() for r in chosen.collect()])  # at most WAVE_BYTES
        counts = rows.where(F.col("lang").isin(langs)).mapInArrow(_counter(sent, parts, widths), COUNTS)
        out = counts if out is None else out.unionByName(counts)
    if out is None:
        return spark.createDataFrame([], f"{COUNTS}, total long")
    keys = ["lang", "shard", "part"]
    return out.repartition(*keys).sortWithinPartitions(*keys, "source").mapInArrow(_adder(widths), f"{COUNTS}, total long")


def block_width(n_sources: int) -> int:
    return max(1, BLOCK // max(1, n_sources))


def _counter(sent, parts: dict[str, int], widths: dict[str, int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(sent.value, parts)
        slots: dict[tuple[str, str, int], np.ndarray] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source, shard), counts in slots.items():
                has = np.flatnonzero(counts)
                part = has // widths[lang]
                yield _count_rows([
                    (lang, source, shard, int(k), has[part == k], counts[has[part == k]]) for k in np.unique(part)])
            slots.clear()

        for batch in batches:
            langs, lang_names = _codes(batch.column(0))
            sources, source_names = _codes(batch.column(1))
            lang_names, source_names = lang_names.to_pylist(), source_names.to_pylist()
            for _, _, doc, code, terms in _stretches(batch.column(2)):
                pairs, n = _counted((langs[doc] * len(source_names) + sources[doc]) * len(terms) + code)
                group, code = pairs // len(terms), pairs % len(terms)
                order = np.argsort(group, kind="stable")
                group, code, n = group[order], code[order], n[order]
                crc, own = _crc32(terms), _hashes(terms)
                edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), len(group)]
                by_lang: dict[str, tuple[np.ndarray, np.ndarray]] = {}
                for i, j in zip(edges, edges[1:]):
                    lang, source = lang_names[group[i] // len(source_names)], source_names[group[i] % len(source_names)]
                    if lang not in by_lang:  # looked up once for all groups of the language
                        shard, index = crc % parts.get(lang, 1), np.full(len(terms), -1, np.int64)
                        wanted = np.zeros(len(terms), bool)
                        wanted[code[group // len(source_names) == group[i] // len(source_names)]] = True
                        for s in np.unique(shard[wanted]):
                            if (lang, int(s)) in hashes.shards:
                                at = np.flatnonzero(wanted & (shard == s))
                                index[at] = hashes.find(lang, int(s), terms.take(pa.array(at)), own[at])
                        by_lang[lang] = shard, index
                    shard, index = by_lang[lang]
                    mine, many = code[i:j], n[i:j]
                    has = index[mine] >= 0
                    mine, many = mine[has], many[has]
                    order = np.argsort(shard[mine], kind="stable")
                    mine, many = mine[order], many[order]
                    cuts = [0, *(np.flatnonzero(np.diff(shard[mine])) + 1), len(mine)] if len(mine) else []
                    for a, b in zip(cuts, cuts[1:]):
                        key = (lang, source, int(shard[mine[a]]))
                        if key not in slots:
                            slots[key] = np.zeros(hashes.shards[key[0], key[2]][0], np.int64)
                            held += slots[key].nbytes
                        slots[key][index[mine[a:b]]] += many[a:b]
                if held > SLOT_BYTES:
                    yield from flush()
                    held = 0
        yield from flush()

    return count


def _count_rows(rows: list[tuple], totals: bool = False) -> pa.RecordBatch:
    """Batch of (lang, source, shard, part, slots, counts): slots as 32-bit, counts as 64-bit numbers."""
    lang, source, shard, part, slots, counts = zip(*rows) if rows else [()] * 6
    columns = [
        pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(shard, pa.int32()), pa.array(part, pa.int32()),
        pa.array([x.astype(np.uint32).tobytes() for x in slots], pa.binary()), pa.array([x.astype(np.int64).tobytes() for x in counts], pa.binary())]
    names = ["lang", "source", "shard", "part", "slots", "n"]
    if totals:
        columns, names = [*columns, pa.array([int(x.sum()) for x in counts], pa.int64())], [*names, "total"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _adder(widths: dict[str, int]):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, dense = None, None

        def done() -> pa.RecordBatch:
            has = np.flatnonzero(dense)
            return _count_rows([(*key, has + key[3] * widths[key[0]], dense[has])], totals=True)

        for batch in batches:
            for r in batch.to_pylist():
                own = (r["lang"], r["source"], r["shard"], r["part"])
                if own != key:
                    if key is not None:
                        yield done()
                    key, dense = own, np.zeros(widths[own[0]], np.int64)
                dense[np.frombuffer(r["slots"], np.uint32) - own[3] * widths[own[0]]] += np.frombuffer(r["n"], np.int64)
        if key is not None:
            yield done()

    return add


# -- shares and divergence --------------------------------------------------------------------

def share(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (n + 1) / (total + terms)), exact for any counts."""
    if len(n) and int(n.max()) >= 9 * 10**9 - 1:  # beyond 64 bits
        return np.array([1 + UNIT * (int(x) + 1) // (total + terms) for x in n], np.int64)
    return 1 + UNIT * (n + 1) // (total + terms)


FOUND = "lang string, part string, s int, t int, item string, value long"


def compared(counts: DataFrame, built: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """Of each block of terms: lang, part, s, t, item, value, s and t being places of sources.

    Part ``pair``: the sum of f over the block for two sources. Part ``term``: at most ``top`` terms of a
    source, the most divergent ones. groups: lang, source, place, total, v. A group of rows is
    a row for each source that has terms of the block, and one with the keys.
    """

    cells = BLOCK

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        info = next(r for r in rows if r["totals"] is not None)
        own = sorted((r for r in rows if r["totals"] is None), key=lambda r: r["place"])
        totals, v = info["totals"], info["v"]
        width = max(1, cells // len(totals))
        base = key[2].as_py() * width
        w = min(width, info["size"] - base)
        present = np.array([r["place"] for r in own])
        dense = np.zeros((len(own), w), np.int64)
        for i, r in enumerate(own):
            dense[i, np.frombuffer(r["slots"], np.uint32) - base] = np.frombuffer(r["n"], np.int64)
        none = np.zeros(1, np.int64)
        p = np.empty((len(totals), w), np.int64)
        for s, total in enumerate(totals):
            p[s] = share(none, total, v)[0]
        for i, s in enumerate(present):
            p[s] = share(dense[i], totals[s], v)
        q = share(dense.sum(0), sum(totals), v)
        kind, first, second, item, value = [], [], [], [], []
        for s in range(len(totals)):
            apart = p - p[s]
            sums = (apart * apart // p).sum(1)
            for t in range(len(totals)):
                if t != s:
                    kind.append("pair")
                    first.append(s)
                    second.append(t)
                    item.append(None)
                    value.append(int(sums[t]))
        terms = _strings(np.frombuffer(info["keys"], np.uint8), np.frombuffer(info["lengths"], np.int32))
        for i, s in enumerate(present):
            at = np.flatnonzero((dense[i] > 0) & (p[s] > q))
            f = (p[s][at] - q[at]) ** 2 // q[at]
            if len(at) > top:
                least = np.partition(f, len(f) - top)[len(f) - top]
                at, f = at[f >= least], f[f >= least]
            best = sorted(zip(-f, terms.take(pa.array(at + base)).to_pylist()))[:top]
            kind += ["term"] * len(best)
            first += [int(s)] * len(best)
            second += [None] * len(best)
            item += [x.decode() for _, x in best]
            value += [int(-x) for x, _ in best]
        return pa.table({
            "lang": pa.array([key[0].as_py()] * len(kind), pa.string()), "part": pa.array(kind, pa.string()), "s": pa.array(first, pa.int32()),
            "t": pa.array(second, pa.int32()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    keys = ["lang", "shard", "part"]
    own = counts.join(groups.select("lang", "source", "place"), ["lang", "source"]).select(*keys, "place", "slots", "n")
    by_lang = groups.groupBy("lang").agg(
        F.max("v").alias("v"), F.sort_array(F.collect_list(F.struct("place", "total"))).getField("total").alias("totals"))
    blocks = counts.select(*keys).distinct().join(built.select("lang", "shard", F.col("n").alias("size"), "lengths", "keys"), ["lang", "shard"])
    info = blocks.join(by_lang, "lang").select(*keys, "size", "lengths", "keys", "v", "totals")
    both = own.unionByName(info, allowMissingColumns=True)
    return both.groupBy(*keys).applyInArrow(compare, FOUND)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank as the report of ``docs`` (text, lang, source; more are ignored).

    Part ``pair``: for each group (lang, source) every other source of the language, value the sum of
    f over the kept terms. Part ``term``: the terms that the group uses more than its language, at
    most ``top``. Null text, lang and source count as ''. Rows without doc_id and repeated rows are
    documents of their own. A language without kept terms has pairs of value 0 and no terms; an
    empty table gives an empty result.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = frequencies(rows).groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    built = stored(shards(stored(kept.select("lang", "term"), "kept")), "shards")
    every = stored(rows.select("lang", "source").distinct(), "groups")  # a row for each group
    counts = stored(recount(rows, built, every.groupBy("lang").agg(F.count("*").alias("n_sources"))), "counts")
    sizes = built.groupBy("lang").agg(F.sum("n").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    groups = every.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("v", F.lit(0)).cast("long").alias("v"),
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place"))
    groups = stored(groups, "totals")

    found = stored(compared(counts, built, groups, top), "found")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = found.where("part = 'term'").join(groups.select("lang", F.col("place").alias("s"), "source"), ["lang", "s"]).select(
        "lang", "source", "part", "item", "value")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    sums = found.where("part = 'pair'").groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("place", "source")).alias("others"))
    pairs = groups.join(others, "lang").select("lang", "source", F.col("place").alias("s"), F.explode("others").alias("other"))
    pairs = pairs.where("s <> other.place").select("lang", "source", "s", F.col("other.place").alias("t"), F.col("other.source").alias("item"))
    pairs = pairs.join(sums, ["lang", "s", "t"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)


@query("op11_divergence", r"""
    with d as (
      select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
      from documents),
    o as (select k, lang, source, unnest(w) as term from d),
    kept as (select lang, term from o group by lang, term having count(distinct k) >= 3),
    v as (select lang, count(*) as v from kept group by lang),
    g as (select distinct lang, source from d),
    c as (select lang, source, term, count(*) as n from o join kept using (lang, term) group by lang, source, term),
    dense as (
      select g.lang, g.source, kept.term, coalesce(c.n, 0) as n
      from g join kept on kept.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
    sums as (
      select lang, source, term, n, sum(n) over (partition by lang, source) as total,
             sum(n) over (partition by lang, term) as lang_n, sum(n) over (partition by lang) as lang_total
      from dense),
    p as (
      select lang, source, term, n, (1 + (1000000000 * (n + 1)::hugeint) // (total + v))::hugeint as p,
             (1 + (1000000000 * (lang_n + 1)::hugeint) // (lang_total + v))::hugeint as q
      from sums join v using (lang)),
    pairs as (
      select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    every as (
      select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pairs.value, 0)::bigint as value
      from g a join g b on a.lang = b.lang and a.source <> b.source
      left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
      union all
      select lang, source, 'term', term, (((p - q) * (p - q)) // q)::bigint from p where n > 0 and p > q)
    select lang, source, part, item, value, rank::int as rank
    from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from every)
    where part = 'pair' or rank <= 200
""")
def op11_divergence(spark, sf_dir):
    """Divergence of the sources of each language over all documents."""
    return divergence(table(spark, sf_dir, "documents"))
