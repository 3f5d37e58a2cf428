"""Near-duplicate classes by one-permutation MinHash.

1. Each text becomes its set of distinct word shingles. One hash per shingle: its leading bits
   choose one of ``bands * rows`` bins, the least hash of a bin is the bin's value. Optimal
   densification: an empty bin copies the first filled one in an order drawn for that bin alone.
2. Texts of equal sets form one class (pre-aggregated, so masses of copies cost nothing);
   the smallest doc_id stands for it.
3. ``rows`` bins make a band, a band's values the key of a bucket. A bucket gives edges in the
   shape of a star: its smallest member against all others. Edges are confirmed on full sets.
4. A star can miss a link between two members that its centre does not join. Buckets whose
   members that have not been centres lie in several components get further stars, around the
   members of the smallest components, 16 times as many each time, until none is left; members
   of one component are not compared again, nor those whose set sizes alone rule a link out.
5. Before sets are compared, an edge must agree on enough bins of a second signature of 2048 bins
   of one bit each (5 standard deviations below the wanted similarity). For the further stars
   signatures and full sets are compared where centres and blocks of a bucket's members meet:
   a centre needs one link into a component, so only links that join components become rows.

With 50 bands of 7 rows a pair of similarity 0.8 shares no bucket with probability 8e-6.
Only edges, labels and single texts are shuffled; nothing is collected to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import durable  # noqa: F401  a test reads it here
from .base import query, stored, table
from .words import LOWER, M3, mix, runs, shingle_hashes, span_hashes, word_spans

BANDS, ROWS = 50, 7
SKETCH = 2048  # bins of the second signature, a bit each
BLOCK = 4096  # members of a bucket that meet its centres in one group
BLOCK_SHINGLES = 4_000_000  # and the shingles of these members, about
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def _orders(bins: int) -> np.ndarray:
    """For each bin its own order of all bins."""
    return np.random.default_rng(7).permuted(np.tile(np.arange(bins, dtype=np.int32), (bins, 1)), axis=1)


def signature(hashes: np.ndarray, bins: int, orders: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature of a sorted array of distinct hashes (not empty)."""
    which = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.concatenate([[True], which[1:] != which[:-1]])
    filled = which[first].astype(np.int64)
    values = np.zeros(bins, np.uint64)
    values[filled] = hashes[first]
    has = np.zeros(bins, bool)
    has[filled] = True
    empty = np.flatnonzero(~has)
    done, width = 0, 8
    while len(empty):
        order = orders[empty, done: done + width]
        hit = has[order]
        found = hit.any(1)
        values[empty[found]] = values[order[found, hit[found].argmax(1)]]
        empty, done, width = empty[~found], done + width, width * 4
    return values


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z are lower-cased, a null text is empty."""
    for first, last, data, offsets in runs(texts):
        data = LOWER[data]
        starts, ends, at = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        for i in range(last - first):
            yield np.unique(shingle_hashes(words[at[i]: at[i + 1]], size))


def band_keys(hashes: np.ndarray, orders: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The key of each band of a sorted array of distinct hashes (not empty)."""
    factors = mix(np.arange(1, rows + 1, dtype=np.uint64) * M3) | np.uint64(1)
    values = signature(hashes, bands * rows, orders).reshape(bands, rows)
    return mix((mix(values) * factors).sum(1) + mix(np.arange(1, bands + 1, dtype=np.uint64)))


def signatures(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, two halves of the set's hash, and a key for each band (none for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(bands * rows)
        for batch in batches:
            n = len(batch)
            counts, a, b = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            keys: list[np.ndarray] = []
            at = np.zeros(n + 1, np.int32)
            for i, hashes in enumerate(shingle_sets(batch.column(1), size)):
                counts[i] = len(hashes)
                at[i + 1] = at[i]
                if len(hashes):
                    a[i] = mix(hashes).sum()
                    b[i] = np.bitwise_xor.reduce(mix(hashes + M3))
                    keys.append(band_keys(hashes, orders, bands, rows))
                    at[i + 1] += bands
            flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, SIGNED)


def members_sets(texts: DataFrame, size: int) -> DataFrame:
    """doc_id, its sorted full set (64-bit hashes), its second signature, and half of each band's key."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, band_orders = _orders(SKETCH), _orders(BANDS * ROWS)
        salts = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * M3)
        for batch in batches:
            sets, out, marks = [], [], []
            for hashes in shingle_sets(batch.column(1), size):
                values = signature(np.sort(mix(hashes)), SKETCH, orders)
                out.append(np.packbits((mix(values + salts) >> np.uint64(63)).astype(bool)).tobytes())
                sets.append(hashes.tobytes())
                marks.append(_mark(band_keys(hashes, band_orders, BANDS, ROWS)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.binary()) for x in (sets, out, marks))], names=["doc_id", "hashes", "sketch", "marks"])

    return texts.select("doc_id", "text").mapInArrow(sketch, "doc_id long, hashes binary, sketch binary, marks binary")


def _mark(keys: np.ndarray) -> np.ndarray:
    """Half of each band key: enough to tell which bands two members share."""
    return (keys >> np.uint64(32)).astype(np.uint32)


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def most_apart(percent: int) -> float:
    """Bits that two second signatures may differ in if the sets may reach the similarity."""
    p = (1 + percent / 100) / 2
    return SKETCH * (1 - p + 5 * math.sqrt(max(p * (1 - p), 0.01) / SKETCH))


def likely(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose second signatures allow the wanted similarity."""
    most = most_apart(percent)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.bitwise_count(_bits(batch.column(2)) ^ _bits(batch.column(3))).sum(1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(apart <= most))

    rows = edges.join(sets.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    rows = rows.join(sets.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    return rows.select("a", "b", "sketch_a", "sketch_b").mapInArrow(agree, "a long, b long")


def linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    both = np.concatenate([one, two])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


class Components:
    """Components of one group of members: labels joined by the links that were found."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, label: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(label, label)) != label:
            parent[label] = label = parent[up]
        return label

    def roots(self, labels: np.ndarray) -> np.ndarray:
        value, where = np.unique(labels, return_inverse=True)
        return np.array([self.root(int(v)) for v in value], np.int64)[where]


def meetings(known: DataFrame, chosen: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of the chosen centres of each bucket and those of its members: pairs of labels.

    known, chosen: bucket, rep, n, label. sizes: bucket, the number of its members and of their shingles.
    Members are dealt over groups of about ``BLOCK`` members and ``BLOCK_SHINGLES`` shingles by a
    hash, the centres go to each group of their bucket. In a group a centre meets the members of
    other components, likeliest first, and full sets decide at once; a link joins both
    components, and what is in one component is not compared any more. So a group gives at
    most one link fewer than it has components, and what stays apart there was compared.
    A pair that shares several buckets is left to the first of them, which stays open until the pair
    was compared there or lies in one component.
    """
    most = most_apart(percent)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, key, joined = [], None, Components()
        for batch in batches:
            bucket, block, role, n, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            bits = _bits(batch.column(5))
            marks = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint32).reshape(-1, BANDS)
            sets_here = batch.column(7)
            here = _mark(bucket.view(np.uint64))
            edges = np.flatnonzero((bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])) + 1
            a, b = [], []
            for i, j in zip([0, *edges], [*edges, len(batch)]) if len(batch) else ():
                if key != (bucket[i], block[i]):
                    centres, key, joined = [], (bucket[i], block[i]), Components()
                first = i + int(np.searchsorted(role[i:j], 1))
                for c in range(i, first):
                    centres.append((n[c], int(label[c]), bits[c].copy(), marks[c].copy(), np.frombuffer(sets_here[c].as_py(), np.uint64)))
                if first == j:
                    continue
                roots = joined.roots(label[first:j])
                for size, of, sketch, bands, full in centres:
                    own = joined.root(of)
                    small, large = np.minimum(n[first:j], size), np.maximum(n[first:j], size)
                    may = np.flatnonzero((roots != own) & (100 * small >= percent * large))
                    if not len(may):
                        continue
                    apart = np.bitwise_count(bits[first + may] ^ sketch).sum(1, dtype=np.int64)
                    may, apart = may[apart <= most], apart[apart <= most]
                    firsts = bands[(marks[first + may] == bands).argmax(1)] == here[i]
                    may, apart = may[firsts], apart[firsts]
                    for m in may[np.argsort(apart, kind="stable")]:
                        if roots[m] != own and linked(full, np.frombuffer(sets_here[first + int(m)].as_py(), np.uint64), percent):
                            a.append(min(of, int(label[first + m])))
                            b.append(max(of, int(label[first + m])))
                            joined.parent[int(roots[m])] = own
                            roots[roots == roots[m]] = own
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    even = F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)
    blocks = sizes.select("bucket", F.greatest(F.lit(1), F.ceil(even)).cast("int").alias("blocks"))
    both = known.join(blocks, "bucket").select(
        "bucket", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), F.lit(1).alias("role"), "rep", "n", "label"
    ).unionAll(chosen.join(blocks, "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0), "rep", "n", "label"))
    both = both.join(sets.select(F.col("doc_id").alias("rep"), "sketch", "marks", "hashes"), "rep")
    both = both.select("bucket", "block", "role", "n", "label", "sketch", "marks", "hashes")
    both = both.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "role")
    return both.mapInArrow(meet, "a long, b long").distinct()


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets have 100 * intersection >= percent * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (one, two) in enumerate(zip(batch.column(2), batch.column(3))):
                keep[i] = linked(np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    rows = edges.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hashes_b")), "b")
    rows = rows.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("hashes_a")), "a")
    return rows.select("a", "b", "hashes_a", "hashes_b").mapInArrow(confirm, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the edges (a, b); nodes without edges are absent.

    Each round every node follows its least neighbours down to one that has no smaller; only edges
    between different ends of these ways are left for the next round, so that most are read once.
    Tables are written, as small ones are then broadcast: each shuffle is a job, and jobs fill the driver.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        least = stored(least.select("node", F.least("node", "m").alias("label")), "least")
        while True:
            further = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
            new = least.join(further, "label").select("node", F.col("label").alias("old"), F.col("further").alias("label"))
            new = stored(new, "least")
            least = new.select("node", "label")
            if new.where("label < old").isEmpty():
                break
        labels = least if labels is None else relabelled(labels, least)
        ends = edges.join(least.select(F.col("node").alias("b"), F.col("label").alias("to_b")), "b")
        ends = ends.join(least.select(F.col("node").alias("a"), F.col("label").alias("to_a")), "a").where("to_a <> to_b")
        edges = stored(ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the label (of ``labels``: node, label) of their label, where it has one."""
    to = labels.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return rows.join(to, "label", "left").select(*[c for c in rows.columns if c != "label"], F.coalesce("to", "label").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text; more columns are ignored).

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable, kept says that it is the row's own.
    A null or wordless text has 0 shingles and is linked with nothing. A row without doc_id
    takes no part: component_id is null and kept true. Rows that repeat a doc_id are judged
    by their own texts. An empty table gives an empty result.
    """
    signed = stored(signatures(docs, shingle), "signed")
    classes = (
        signed.where("doc_id is not null and n_shingles > 0")
        .groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    )
    classes = stored(classes, "classes")
    placed = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("centre")).where("size > 1")
    members = stored(placed.join(shared, "bucket").select("bucket", "rep", "n", "size", "centre"), "members")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = stored(members_sets(texts, shingle), "sets")

    # The smallest member of each bucket against the others; sizes alone rule many links out.
    sizes = members.where("rep = centre").select("bucket", F.col("n").alias("n_centre"))
    tested = stored(
        members.where("rep <> centre").join(sizes, "bucket")
        .where(f"100 * least(n, n_centre) >= {percent} * greatest(n, n_centre)")
        .select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "tested"
    )
    # Labels and steps are written: later plans name them several times, unwritten they would double with each round.
    labels = stored(components(confirmed(stored(likely(tested, sets, percent), "likely"), sets, percent)), "labels")
    # Members that have not been centres; a bucket of two is done.
    known = members.where("size > 2 and rep <> centre").select("bucket", "rep", "n", F.col("rep").alias("label"))
    centres, step = 32, labels
    while True:
        known = stored(relabelled(known, step), "known")
        shares = stored(known.groupBy("bucket", "label").agg(F.count("*").alias("share"), F.sum("n").alias("shingles")), "shares")
        split = shares.groupBy("bucket").agg(
            F.count("*").alias("labels"), F.sum("share").alias("size"), F.sum("shingles").alias("shingles"),
            F.max(F.struct("share", "label"))["label"].alias("largest")).where("labels > 1")
        split = stored(split, "split")
        if split.isEmpty():
            break
        known = stored(known.join(split.select("bucket"), "bucket"), "known")
        # The smallest components of a bucket first; the largest needs no centres, as it is left over in the end.
        order = Window.partitionBy("bucket").orderBy("share", "label")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        small = shares.join(split.select("bucket", "largest"), "bucket").where("label <> largest")
        small = small.withColumn("before", F.coalesce(F.sum("share").over(before), F.lit(0))).where(F.col("before") < centres)
        chosen = known.join(small.select("bucket", "label", "before"), ["bucket", "label"])
        inside = Window.partitionBy("bucket").orderBy("before", "rep")
        chosen = chosen.withColumn("at", F.row_number().over(inside)).where(F.col("at") <= centres).select("bucket", "rep", "n", "label")
        chosen = stored(chosen, "chosen")
        step = stored(components(meetings(known, chosen, split, sets, percent)), "step")
        labels = stored(relabelled(labels, step).unionAll(step.join(labels, "node", "left_anti")), "labels")
        known = known.join(chosen.select("bucket", "rep"), ["bucket", "rep"], "left_anti")
        centres *= 16

    found = classes.select("set_a", "set_b", "n_shingles", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    found = stored(found.select("set_a", "set_b", "n_shingles", F.coalesce("label", "rep").alias("component_id")), "found")
    judged = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(found, ["set_a", "set_b", "n_shingles"], "left")
    return judged.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


@query("op1_minhash")
def op1_minhash(spark, sf_dir):
    """Classes of documents over 2-word shingles, similarity of at least 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
