"""Shards of near-equal size by sampled splitters, in DataFrame functions only.

The records are put in the order of a 64-bit hash of their text, then of doc_id, so equal texts
are neighbours. A size-weighted sample of keys gives quantile boundaries; they cut the order
into ranges. A range that is overfull is subdivided: by even cuts of its interval of keys, or,
where one key fills it (a boundary drawn twice), by a hash of the row. A key of too many rows for
one task, however small they are, is found by a count and cut by a hash of the row. Counts and bytes of all
ranges then give each record its exact place in the order, and a shard is an equal stretch
of all bytes: no shard is off by more than one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import query, stored, table

SAMPLE = 8192  # keys drawn, about; what the driver gets of them are at most RANGES boundaries
RANGES = 256
RANGE_ROWS = 200_000  # a range with more rows than this, or twice its share of bytes, is subdivided
SPAN = float(1 << 64)


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many boundaries are <= key, by comparisons in the shape of a balanced tree."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(bounds[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(bounds))


def boundaries(rows: DataFrame, total: int) -> list[int]:
    """Sorted quantile boundaries of the keys, weighted by size.

    A row is drawn if a hash of it, uniform on [0, 1), is below its share of ``SAMPLE`` draws;
    a row that is due several draws counts so often.
    """
    due = F.col("size") * F.lit(SAMPLE / max(total, 1))
    chance = F.pmod(F.xxhash64("doc_id", "key", F.lit(11)), F.lit(1 << 32)) / float(1 << 32)
    drawn = rows.select("key", (F.floor(due) + (chance < due - F.floor(due)).cast("long")).alias("weight")).where("weight > 0")
    levels = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    found = drawn.agg(F.expr("1").alias("one"), F.percentile("key", levels, F.col("weight")).alias("q")).first()["q"]
    return sorted(int(q) for q in found) if found else []


def place(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text).

    size: UTF-8 bytes of the text plus 16, a null text has none. Law ``bytes``: shard i holds the
    records whose middle byte, in the order over all, lies in the i-th of ``shards`` equal parts;
    slot counts a shard's records from 0 without gaps; grown_shard is null under this law.
    Null doc_ids come first among equal texts; repeated rows get slots of their own; an empty
    table gives an empty result, columns beyond doc_id and text are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("nth"),
    )
    rows = stored(rows, "rows")
    # Keys of more rows than one task should sort, by one count (combined where the rows are read): at most rows / RANGE_ROWS.
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > RANGE_ROWS)
    hot = stored(hot.select("key", F.ceil(F.col("n") / RANGE_ROWS).cast("long").alias("hot_parts")), "hot")
    total = rows.agg(F.sum("size")).first()[0] or 0
    bounds = boundaries(rows, total)
    # A boundary drawn twice or more is a key that fills a range: [key, key + 1) becomes a range of its own.
    heavy = sorted({x for x, y in zip(bounds, bounds[1:]) if x == y})
    cuts = sorted(set(bounds) | {x + 1 for x in heavy if x + 1 < 1 << 63})
    ranged = rows.withColumn("range", _range_of(F.col("key"), cuts))

    sums = ranged.groupBy("range").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
    share = max(total, 1) / RANGES
    parts = F.ceil(F.greatest(F.col("n") / RANGE_ROWS, F.when(F.col("bytes") > 2 * share, F.col("bytes") / share).otherwise(1))).cast("long")
    plan = F.broadcast(sums.select("range", "low", "high", parts.alias("parts")))  # at most 2 * RANGES rows
    by_key = F.floor((F.col("key").cast("double") - F.col("low").cast("double"))
                     / (F.col("high").cast("double") - F.col("low").cast("double") + 1) * F.col("parts"))
    by_id = F.pmod(F.xxhash64("doc_id", "nth"), F.col("parts"))
    sub = F.when(F.col("parts") == 1, F.lit(0)).when(F.col("low") == F.col("high"), by_id).otherwise(
        F.least(by_key, F.col("parts") - 1)).cast("long")
    # The rows of a hot key stand after the others of their stretch, in parts of their own.
    piece = F.when(F.col("hot_parts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", "nth"), F.col("hot_parts"))).cast("long")
    ranged = ranged.join(plan, "range").join(hot, "key", "left").select(
        "doc_id", "size", "text_crc32", "key", "range", sub.alias("sub"), F.when(F.col("hot_parts").isNotNull(), F.col("key")).alias("hot"), piece.alias("piece"))
    ranged = ranged.withColumn("stretch", F.xxhash64("range", "sub", "hot", "piece"))

    before = Window.orderBy("range", "sub", "hot", "piece").rowsBetween(Window.unboundedPreceding, -1)
    cells = ["range", "sub", "hot", "piece", "stretch"]
    offsets = ranged.groupBy(*cells).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select(
        "range", "sub", "piece", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    keys = ["range", "sub", "piece", "stretch"]
    inside = Window.partitionBy(*keys).orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    order = ranged.withColumns({"at": F.row_number().over(inside), "upto": F.sum("size").over(inside)}).join(offsets, keys)
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") / 2
    placed = order.select(
        "doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("at") - 1).alias("rank"),
        F.least(F.floor(middle * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int").alias("shard"))
    placed = stored(placed, "placed")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("rank").alias("first")))  # a row for each shard
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


@query("op9_shards")
def op9_shards(spark, sf_dir):
    """All documents over 40 shards of near-equal bytes."""
    return place(table(spark, sf_dir, "documents"), 40)
