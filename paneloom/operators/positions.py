"""Exact row positions without sorting a whole table in one task.

``hash_positions`` numbers rows in md5 order of a key. Rows are counted per md5
prefix first; the running total of those counts gives each prefix its offset, and
only rows sharing a prefix are numbered together. The prefix is as long as the
largest group asks for, so a bucket has about ``BUCKET_ROWS`` rows at most.

``ordered_positions`` numbers rows in a stated column order: range partitioning
(which splits a hot leading key by the later columns), one checkpoint so that
partition numbers stay fixed, then the same offset step over partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable


BUCKET_ROWS = 500_000


def key_hash(*keys: str | Column, seed: int = 0) -> Column:
    """md5 of seed and key, the same in any SQL engine."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _number(df: DataFrame, by: Sequence[str], bucket: str, order: Sequence, out: str) -> DataFrame:
    """0-based position from per-bucket counts; bucket order must agree with ``order``.

    Group and bucket form one text key, on which the rows are shuffled once, both for
    the offsets and for numbering inside a bucket.
    """
    group = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in by]
    keyed = df.withColumn("_key", F.concat_ws("\u001f", *group, F.col(bucket).cast("string")))
    counts = keyed.groupBy(*by, bucket, "_key").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_key", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_key").orderBy(*order)
    return (
        keyed.join(offsets, "_key")
        .withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1)
        .select(*[c for c in df.columns if c != bucket], out)
    )


def hash_positions(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str] = (),
    seed: int = 0,
    out: str = "position",
    prefix: int | None = None,
) -> DataFrame:
    """0-based position of each row in md5 order of ``keys`` within ``by``.

    ``prefix``: hexadecimal digits that make a bucket; by default at least 3, and more if the
    largest bucket of 3 (counted now) is too full.
    """
    hashed = df.withColumn("_h", key_hash(*keys, seed=seed))
    if prefix is None:
        sizes = hashed.groupBy(*by, F.substring("_h", 1, 3).alias("_bucket")).agg(F.count("*").alias("_n"))
        largest = sizes.agg(F.max("_n")).first()[0] or 1
        prefix = 3 + max(0, math.ceil(math.log(largest / BUCKET_ROWS, 16)))
    hashed = hashed.withColumn("_bucket", F.substring("_h", 1, prefix))
    return _number(hashed, by, "_bucket", ["_h", *keys], out).drop("_h")


def ordered_positions(df: DataFrame, order: Sequence[str], out: str = "position") -> DataFrame:
    """0-based position of each row in the order of ``order`` (runs one checkpoint).

    Pass only the columns that are needed: what is passed is checkpointed.
    """
    ranged = df.repartitionByRange(*order).withColumn("_bucket", F.spark_partition_id())
    return _number(durable(ranged), (), "_bucket", list(order), out)
