"""Mixing of sources to target weights by systematic sampling.

A source's documents are put in the order of size (then of a hash of doc_id); each is due
target / source size copies. The running sum of the copies due, plus one offset drawn for the
source, is cut at the whole numbers: a document is emitted once for each that it crosses. As
neighbours in the order are of like size, the words taken come near the target as well.
The running sum is exact: rows are counted in cells of (source, size step, hash), and only
inside a cell, whose number grows with the source, are they numbered by a sort. Sources are few (their
targets come from windows over a row for each).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .base import query, stored, table

CAP = 3  # times a source's size that its target may be
CELL_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: float = CAP) -> DataFrame:
    """source, source_size, weight, target: 100% of all sizes by weight, at most ``cap`` times the own size.

    What a capped source cannot take goes to the others by weight. In the order of size per weight
    the capped sources come first, and a source is capped iff it is when all before it are: one
    running sum over the sources (a row each) solves it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    so_far, on = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    rows = rows.withColumns({
        "left": F.sum("source_size").over(all_) - F.lit(cap) * F.coalesce(F.sum("source_size").over(so_far), F.lit(0)),
        "weights": F.sum("weight").over(on),
    })
    rows = rows.withColumn("capped", F.col("left") * F.col("weight") / F.col("weights") > cap * F.col("source_size"))
    share = F.max(F.when(~F.col("capped"), F.struct(F.col("weights"), (F.col("left") / F.col("weights")).alias("each")))).over(all_)["each"]
    return rows.select(
        "source", "source_size", "weight",
        F.when(F.col("capped"), cap * F.col("source_size")).otherwise(F.col("weight") * share).cast("double").alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every row of ``docs`` (doc_id, text, source), and ``keep``.

    size: words of the text (null: 0). Sources take the weights by code point, null last, in turn.
    copies is floor or ceiling of target / source_size, at most 3; taken = copies * size.
    A source without words has target 0 and no copies. Null doc_ids and repeated rows are
    rows like any other; an empty table gives an empty result. Reruns agree: offset and order
    come from hashes.
    """
    words = F.size(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"),
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(seed)).alias("mark"),
        F.monotonically_increasing_id().alias("nth"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    sized = stored(sized, "sized")
    # Cells keep the order: by size first (steps of 1/32 of a power of two), within a step by a part of the hash.
    step = F.floor(F.log2(F.col("size") + 1) * 32)
    # Rows of one mark are alike (doc_id and text), so their order among themselves is free: too many for a task are cut by row.
    hot = sized.groupBy("source", step.alias("step"), "mark").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS)
    hot = stored(hot.select(F.col("source").alias("hot_source"), F.col("step").alias("hot_step"), F.col("mark").alias("hot_mark"),
                            F.ceil(F.col("n") / CELL_ROWS).alias("hot_parts")), "hot")
    counts = sized.groupBy("source", step.alias("step")).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    counts = stored(counts, "counts")
    goal = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    parts = F.ceil(F.col("n") / CELL_ROWS).cast("long")
    cells = counts.select("source", "step", parts.alias("parts")).where("parts > 1")
    rows = sized.withColumn("step", step).join(
        cells.select(F.col("source").alias("s"), F.col("step").alias("t"), "parts"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("step") == F.col("t")), "left")
    rows = rows.withColumn("part", F.floor(
        F.pmod("mark", F.lit(1 << 32)) / float(1 << 32) * F.coalesce("parts", F.lit(1)))).drop("s", "t", "parts")
    rows = rows.join(hot, F.col("source").eqNullSafe(F.col("hot_source")) & (F.col("step") == F.col("hot_step")) & (F.col("mark") == F.col("hot_mark")), "left")
    piece = F.when(F.col("hot_parts").isNotNull(), F.pmod(F.xxhash64("nth"), F.col("hot_parts"))).otherwise(F.lit(-1)).cast("long")
    # The rows of a hot mark stand after the others of their cell.
    rows = rows.withColumn("piece", piece).withColumn("hot_mark", F.when(F.col("piece") >= 0, F.col("mark")).otherwise(F.lit(0))).drop("hot_source", "hot_step", "hot_parts")
    cell = rows.groupBy("source", "step", "part", "hot_mark", "piece").agg(F.count("*").alias("n"))
    place = F.struct(F.col("piece") >= 0, "hot_mark", "piece")
    before = Window.partitionBy("source").orderBy("step", "part", place).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.lit(seed + 1)), F.lit(1 << 32)) / float(1 << 32)
    plan = cell.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    plan = plan.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    plan = plan.select(
        F.col("source").alias("s"), F.col("step").alias("t"), F.col("part").alias("p"), F.col("hot_mark").alias("h"), F.col("piece").alias("c"),
        "before", "source_size", "target",
        offset.alias("offset"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("due"))
    inside = Window.partitionBy("source", "step", "part", "hot_mark", "piece").orderBy("size", "mark", "doc_id", *[f"kept_{c}" for c in keep])
    at = rows.withColumn("at", F.row_number().over(inside)).join(
        plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("step") == F.col("t")) & (F.col("part") == F.col("p"))
        & (F.col("hot_mark") == F.col("h")) & (F.col("piece") == F.col("c")))
    rank = F.col("before") + F.col("at")
    copies = (F.floor(F.col("due") * rank + F.col("offset")) - F.floor(F.col("due") * (rank - 1) + F.col("offset"))).cast("long")
    out = at.withColumn("copies", copies)
    return out.select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        *[F.col(f"kept_{c}").alias(c) for c in keep])


@query("op8_mixing")
def op8_mixing(spark, sf_dir):
    """All documents mixed by weights 1, 2, 3 of their sources in turn."""
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
