"""Exact joins of vectors whose work is cut by bounds: cosine above a threshold, nearest members.

Vectors are put into the parts of their nearest pivots (a bounded sample of the vectors). What
lies in a part is known by a centre and a radius, so the triangle inequality says for most
pairs of parts, and for most vectors against a part, that nothing in there can qualify. The
result does not depend on pivots, parts or blocks; only the work does.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import durable, stored

PIVOTS = 128  # vectors that the driver holds as pivots, at most
SAMPLE = 1024  # vectors that the driver compares to guess a threshold, at most
PAGE = 1024  # blocks whose centres one task compares
TILES = 16  # tiles that the blocks are dealt to, and blocks of a tile at most
BINS = 65_536  # bins that similarities above a guess are counted in
STRIPE = 4_000_000  # numbers of a matrix that a task holds at once
EPS = 1e-9  # rounding of a bound
ANGLE = 1e-6  # rounding of an angle, which is coarse near 0


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lists(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()))


def _hash_sample(rows: DataFrame, id_: str, vec: str, most: int) -> np.ndarray:
    """``most`` vectors at the lowest hashes of their ids (a bounded collect)."""
    found = rows.select(F.xxhash64(id_).alias("h"), F.col(id_).alias("id"), vec).orderBy("h", "id").limit(most).collect()
    return np.array([r[2] for r in found], np.float64)


def _spread(rows: DataFrame, part: str, id_: str, sizes: dict[int, int], block_rows: int) -> tuple[DataFrame, int]:
    """Adds ``block``: parts are cut evenly by a hash, so a part that holds a third of all rows is many blocks."""
    chunks = {p: max(1, math.ceil(n / block_rows)) for p, n in sizes.items()}
    first, total = {}, 0
    for p in sorted(chunks):
        first[p], total = total, total + chunks[p]
    table = lambda d: F.create_map(*[F.lit(x).cast("int") for kv in d.items() for x in kv])  # noqa: E731  at most PIVOTS entries
    chunk = F.pmod(F.xxhash64(id_, F.lit(3)), table(chunks)[F.col(part)]).cast("int")
    return rows.withColumn("block", table(first)[F.col(part)] + chunk), total


# ---------------------------------------------------------------- cosine join


def unit_vectors(vectors: DataFrame, id_: str, vec: str) -> DataFrame:
    """id, v: vectors of length one. Null vectors and those of length zero have no direction: they are left out."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    rows = vectors.select(F.col(id_).alias("id"), F.col(vec).alias("x"), norm.alias("norm")).where("norm > 0")
    return rows.select("id", F.transform("x", lambda x: x.cast("double") / F.col("norm")).alias("v"))


BLOCKS = "block int, n long, ids array<{kind}>, vectors binary, centre array<double>, radius double"


def block_table(units: DataFrame, sample: np.ndarray, block_rows: int | None) -> tuple[DataFrame, int, int]:
    """A row for each block of unit vectors near one pivot: ids, matrix, centre and widest angle. Written once.

    Also the numbers of blocks and of vectors. By default a block has a sixteenth of all vectors, within
    bounds. The first vectors of the sample are the pivots, as many as blocks are wanted; the
    whole sample says how large the part of each will be, and so into how many blocks it is cut.
    """
    n = units.count()
    block_rows = block_rows or min(4000, max(500, n // 16))
    pivots = sample[: max(1, min(PIVOTS, n // block_rows))]
    shares = np.bincount((sample @ pivots.T).argmax(1), minlength=len(pivots)) / max(1, len(sample)) if len(sample) else np.zeros(0)
    sizes = {i: math.ceil(n * float(share)) for i, share in enumerate(shares)}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = (_matrix(batch.column(1)) @ pivots.T).argmax(1) if len(batch) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=["id", "v", "part"])

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        matrix = _matrix(rows.column("v"))
        centre = matrix.mean(0)
        length = np.linalg.norm(centre)
        centre = centre / length if length > 0 else matrix[0]
        radius = float(np.arccos(np.clip((matrix @ centre).min(), -1, 1)))
        ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column("id").combine_chunks())
        return pa.table({
            "block": rows.column("block").slice(0, 1), "n": [len(rows)], "ids": ids,
            "vectors": pa.array([matrix.tobytes()], pa.binary()), "centre": _lists(centre[None]), "radius": [radius]})

    kind = units.schema["id"].dataType.simpleString()
    parts = units.mapInArrow(assign, f"id {kind}, v array<double>, part int")
    spread, total = _spread(parts, "part", "id", sizes, block_rows)
    blocks = spread.select("block", "id", "v").groupBy("block").applyInArrow(pack, BLOCKS.format(kind=kind))
    return stored(blocks, "blocks"), total, n


def block_pairs(blocks: DataFrame, total: int, at_least: float) -> DataFrame:
    """(bi, bj), bi <= bj, of blocks that can hold a pair with a cosine of ``at_least``.

    Two vectors are at least as far apart as their centres less both radii. Centres are compared in
    pages of ``PAGE`` blocks, so this step is as even as the join itself.
    """
    pages = math.ceil(total / PAGE)
    own = F.floor(F.col("block") / PAGE).cast("int")
    rows = blocks.select("block", "centre", "radius", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
    rows = rows.select(F.least("own", "other").alias("pi"), F.greatest("own", "other").alias("pj"), "own", "block", "centre", "radius")
    widest = math.acos(max(-1.0, min(1.0, at_least)))

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        own, block, radius = (rows.column(c).to_numpy() for c in ("own", "block", "radius"))
        centres = _matrix(rows.column("centre"))
        i, j = np.flatnonzero(own == key[0].as_py()), np.flatnonzero(own == key[1].as_py())
        apart = np.arccos(np.clip(centres[i] @ centres[j].T, -1, 1)) - radius[i][:, None] - radius[j][None, :]
        a, b = np.nonzero((apart <= widest + ANGLE) & (block[i][:, None] <= block[j][None, :]))
        return pa.table({"bi": pa.array(block[i][a], pa.int32()), "bj": pa.array(block[j][b], pa.int32())})

    return rows.groupBy("pi", "pj").applyInArrow(compare, "bi int, bj int")


def _candidates(x: np.ndarray, y: np.ndarray, at_least: float, at_most: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors (single precision) whose cosine may lie within the limits, up to the rounding of their products."""
    slack = (x.shape[1] + 8) * float(np.finfo(np.float32).eps)
    products = x @ y.T
    may = products >= at_least - slack
    if at_most < 1:
        may &= products <= at_most + slack
    return np.divmod(np.flatnonzero(may), max(1, len(y)))


def _compared(
    blocks: DataFrame, total: int, at_least: float, emit: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], schema: str, at_most: float = 1.0,
) -> DataFrame:
    """What ``emit`` makes of the (ids, ids, similarities) of the pairs with a cosine of ``at_least``, for each pair of tiles.

    Pairs above ``at_most`` may be left out.

    Only block pairs that can qualify are compared. There a vector is left out if its own angle
    to the other block's centre rules it out, and a pair if its product in single precision does. Pairs below the threshold never leave a task. A tile is a
    ``TILES``-th of the blocks, so a block travels ``TILES`` times, not once for every other block.
    """
    widest = math.acos(max(-1.0, min(1.0, at_least)))
    size = max(1, min(TILES, math.ceil(total / TILES)))

    def pair(a: tuple, b: tuple, same: bool) -> Iterator[tuple]:
        (ids_a, x, centre_a, radius_a, short_x), (ids_b, y, centre_b, radius_b, short_y) = a, b
        left, right = np.arange(len(x)), np.arange(len(y))
        if not same:
            left = np.flatnonzero(np.arccos(np.clip(x @ centre_b, -1, 1)) - radius_b <= widest + ANGLE)
            right = np.flatnonzero(np.arccos(np.clip(y @ centre_a, -1, 1)) - radius_a <= widest + ANGLE)
        short_y = short_y[right]
        step = max(1, STRIPE // max(1, len(right)))
        for at in range(0, len(left), step):
            own = left[at: at + step]
            i, j = _candidates(short_x[own], short_y, at_least, at_most)
            i, j = own[i], right[j]
            if same:
                i, j = i[i < j], j[i < j]
            for p in range(0, len(i), max(1, STRIPE // x.shape[1])):
                u, v = i[p: p + STRIPE // x.shape[1]], j[p: p + STRIPE // x.shape[1]]
                sim = np.einsum("ij,ij->i", x[u], y[v])
                hit = sim >= at_least
                yield ids_a[u[hit]], ids_b[v[hit]], sim[hit]

    def pairs_of(key: tuple, sides: dict[int, tuple]) -> Iterator[tuple]:
        one, two = ([k for k in sorted(sides) if k // size == tile.as_py()] for tile in key)
        for a in one:
            for b in two:
                if a <= b and np.arccos(np.clip(sides[a][2] @ sides[b][2], -1, 1)) - sides[a][3] - sides[b][3] <= widest + 2 * ANGLE:
                    yield from pair(sides[a], sides[b], a == b)

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {}
        for batch in batches:
            for r in batch.select(["block", "n", "ids", "vectors", "centre", "radius"]).to_pylist():
                matrix = np.frombuffer(r["vectors"], np.float64).reshape(r["n"], -1)
                sides[r["block"]] = (np.array(r["ids"]), matrix, np.array(r["centre"]), r["radius"], matrix.astype(np.float32))
        yield from emit(pairs_of(key, sides))

    tile = lambda c: F.floor(F.col(c) / size).cast("int")
    pairs = block_pairs(blocks, total, at_least).select(tile("bi").alias("ti"), tile("bj").alias("tj"), F.explode(F.array("bi", "bj")).alias("block"))
    rows = pairs.distinct().join(blocks.select("block", "n", "ids", "vectors", "centre", "radius"), "block")
    return rows.groupBy("ti", "tj").applyInArrow(compare, schema)


def matches(blocks: DataFrame, total: int, at_least: float) -> DataFrame:
    """src < dst, similarity: all pairs of the block table with a cosine of ``at_least`` or more."""
    kind = blocks.schema["ids"].dataType.elementType
    id_type = to_arrow_type(kind)

    def emit(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for first, second, sim in found:
            swap = first > second
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(swap, second, first)).cast(id_type), pa.array(np.where(swap, first, second)).cast(id_type), pa.array(sim)],
                names=["src", "dst", "similarity"])

    name = kind.simpleString()
    return _compared(blocks, total, at_least, emit, f"src {name}, dst {name}, similarity double")


def _bin(sim: np.ndarray, low: float) -> np.ndarray:
    """Which of ``BINS`` even bins from ``low`` to 1."""
    return np.clip(((sim - low) * (BINS / (1.0 + EPS - low))).astype(np.int64), 0, BINS - 1)


def bin_counts(blocks: DataFrame, total: int, low: float) -> np.ndarray:
    """Numbers of pairs per bin from ``low`` to 1. At most ``BINS`` rows leave a task or reach the driver."""

    def emit(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.int64)
        for _, _, sim in found:
            counts += np.bincount(_bin(sim, low), minlength=BINS)
        bins = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(counts[bins])], names=["bin", "n"])

    out = np.zeros(BINS, np.int64)
    for r in _compared(blocks, total, low, emit, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out


def values_in(blocks: DataFrame, total: int, low: float, bins: tuple[int, int]) -> DataFrame:
    """(similarity, n): the distinct values in some bins from ``low`` to 1, and how many pairs have each."""
    width = (1.0 + EPS - low) / BINS

    def emit(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for _, _, sim in found:
            at = _bin(sim, low)
            value, n = np.unique(sim[(at >= bins[0]) & (at <= bins[1])], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], names=["similarity", "n"])

    lowest, highest = max(low, low + bins[0] * width - EPS), low + (bins[1] + 1) * width + EPS
    rows = _compared(blocks, total, lowest, emit, "similarity double, n long", 1.0 if bins[1] == BINS - 1 else highest)
    return rows.groupBy("similarity").agg(F.sum("n").alias("n"))


def _at_ranks(values: DataFrame, ranks: Sequence[int]) -> list[float]:
    """The values at 0-based ranks, each value repeated ``n`` times. One bin of pairs, so one ordered window."""
    upto = F.sum("n").over(Window.orderBy("similarity").rowsBetween(Window.unboundedPreceding, 0))
    rows = values.withColumn("upto", upto)
    wanted = reduce(lambda a, b: a | b, [(F.col("upto") > k) & (F.col("upto") - F.col("n") <= k) for k in ranks])
    found = rows.where(wanted).collect()  # at most a row for each rank
    return [next(r["similarity"] for r in found if r["upto"] - r["n"] <= k < r["upto"]) for k in ranks]


def cosine_join(
    vectors: DataFrame, id_: str, vec: str, quantile: float | None = 0.98, at_least: float | None = None, block_rows: int | None = None,
) -> DataFrame:
    """Pairs (src < dst) with a cosine of ``at_least``, or of the interpolated ``quantile`` over all pairs, exactly.

    For a quantile a sample gives a threshold that lies safely below it. The pairs above that one are
    counted in bins; as the number of all pairs is known, the wanted value is an order statistic of
    one bin, whose distinct values are then looked at. If the guess was too high, which the count
    shows, it is lowered and counted again. No pair is written: the result is compared when it is read.
    """
    units = unit_vectors(vectors, id_, vec)
    sample = _hash_sample(units, "id", "v", SAMPLE)
    if not len(sample):
        kind = vectors.schema[id_].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"src {kind}, dst {kind}, similarity double")
    blocks, total, n = block_table(units, sample, block_rows)
    if at_least is not None:
        return matches(blocks, total, at_least)
    pairs = n * (n - 1) // 2
    position = (pairs - 1) * quantile
    low = int(position)
    high, part = min(low + 1, pairs - 1), position - low
    known = np.sort((sample @ sample.T)[np.triu_indices(len(sample), 1)])
    margin = 0.0 if len(sample) == n else 4 * math.sqrt(max(quantile * (1 - quantile), 1e-4) / len(sample))
    while True:
        level = quantile - margin
        guess = float(known[int(level * (len(known) - 1))]) - EPS if len(known) and level > 0 else -1.0 - EPS
        if pairs == 0:
            return matches(blocks, total, guess)
        upto = np.cumsum(bin_counts(blocks, total, guess))
        above = int(upto[-1])
        if above >= pairs - low:
            break
        margin = max(2 * margin, 0.05)
    ranks = [above - (pairs - low), above - (pairs - high)]
    first, last = (int(x) for x in np.searchsorted(upto, ranks, side="right"))
    before = int(upto[first - 1]) if first else 0
    value = _at_ranks(values_in(blocks, total, guess, (first, last)), [k - before for k in ranks])
    return matches(blocks, total, value[0] + (value[1] - value[0]) * part)


# ---------------------------------------------------------------- nearest members


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, summed dimension by dimension: equal vectors are at exactly 0."""
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        apart = x[:, k: k + 1] - y[:, k]
        out += apart * apart
    return out


def _least(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` least finite values of each row; of equals the first columns."""
    keep = min(k, d.shape[1])
    kth = np.partition(d, keep - 1, axis=1)[:, keep - 1: keep]
    less, equal = d < kth, d == kth
    taken = less | (equal & (np.cumsum(equal, axis=1) <= keep - less.sum(1, keepdims=True)))
    return np.nonzero(taken & np.isfinite(d))


def nearest_members(seeds: DataFrame, members: DataFrame, pos: str, vec: str, k: int, block_rows: int = 4000) -> DataFrame:
    """(seed, other, rank): the ``k`` nearest of ``members`` to each of ``seeds`` (members too), itself left out.

    Exact in Euclidean distance, equal distances by the smaller ``pos``. A seed meets its own part
    first; the k-th distance found there rules out the parts that the triangle inequality puts
    further away, and the rest are searched. A task gives at most ``k`` rows for a seed and a
    block of members, however many members are equal.
    """
    pivots = _hash_sample(members, pos, vec, PIVOTS)
    spark = members.sparkSession
    if not len(pivots):
        return spark.createDataFrame([], "seed long, other long, rank int")
    pivots = pivots[: max(1, min(PIVOTS, len(pivots), math.ceil(math.sqrt(members.count()))))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                d = _distances(_matrix(batch.column(1)), pivots)
                part = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(part, pa.int32()), pa.array(np.sqrt(d[np.arange(len(d)), part]))], names=["pos", "x", "part", "d"])

    rows = members.select(F.col(pos).cast("long").alias("pos"), F.col(vec).cast("array<double>").alias("x"))
    rows = durable(rows.mapInArrow(assign, "pos long, x array<double>, part int, d double"))
    stats = {r["part"]: r for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.max("d").alias("radius")).collect()}  # <= PIVOTS rows
    chunks = {p: max(1, math.ceil(r["n"] / block_rows)) for p, r in stats.items()}
    count = F.create_map(*[F.lit(x).cast("int") for kv in chunks.items() for x in kv])[F.col("part")]
    asked = rows.join(seeds.select(F.col(pos).cast("long").alias("pos")).distinct(), "pos", "left_semi")

    def search(visits: DataFrame) -> DataFrame:
        """visits: pos, x, part. Members and visits of a part meet in even blocks."""
        slot = lambda salt: F.pmod(F.xxhash64("pos", F.lit(salt)), count).cast("int")
        every = F.explode(F.sequence(F.lit(0), count - 1))
        a = visits.select("part", "pos", "x", F.lit(True).alias("asks"), slot(1).alias("i")).withColumn("j", every)
        b = rows.select("part", "pos", "x", F.lit(False).alias("asks"), slot(2).alias("j")).withColumn("i", every)

        def compare(group: pa.Table) -> pa.Table:
            group = group.sort_by("pos")
            asks, own, x = group.column("asks").to_numpy(), group.column("pos").to_numpy(), _matrix(group.column("x"))
            p, q, u, v = own[asks], own[~asks], x[asks], x[~asks]
            found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            step = max(1, STRIPE // max(1, len(q)))
            for at in range(0, len(p) if len(q) else 0, step):
                d = _distances(u[at: at + step], v)
                d[p[at: at + step, None] == q[None, :]] = np.inf
                i, j = _least(d, k)
                found.append((p[at: at + step][i], q[j], d[i, j]))
            seed, other, d = (np.concatenate(c) for c in zip(*found))
            return pa.table({"seed": seed, "other": other, "d": d})

        both = a.select("part", "i", "j", "pos", "x", "asks").unionByName(b.select("part", "i", "j", "pos", "x", "asks"))
        return both.groupBy("part", "i", "j").applyInArrow(compare, "seed long, other long, d double")

    best = Window.partitionBy("seed").orderBy("d", "other")
    near = durable(search(asked.select("pos", "x", "part")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    reach = near.groupBy("seed").agg(F.when(F.count("*") == k, F.max("d")).alias("reach"))
    radius = np.array([stats[p]["radius"] if p in stats else -1.0 for p in range(len(pivots))])

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own = batch.column(2).to_numpy()
                reach = np.sqrt(batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64))
                reach = np.where(np.isnan(reach), np.inf, reach)
                away = np.sqrt(_distances(_matrix(batch.column(1)), pivots))
                open_ = (away - radius <= (reach * (1 + EPS) + EPS)[:, None]) & (radius >= 0)
                open_[np.arange(len(own)), own] = False
                i, part = np.nonzero(open_)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.array(part, pa.int32())], names=["pos", "x", "part"])

    visits = asked.join(reach, F.col("pos") == F.col("seed"), "left").select("pos", "x", "part", "reach")
    more = search(visits.mapInArrow(further, "pos long, x array<double>, part int"))
    rows_all = near.select("seed", "other", "d").unionByName(more)
    ranked = rows_all.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < k)
    return ranked.select("seed", "other", "rank")

