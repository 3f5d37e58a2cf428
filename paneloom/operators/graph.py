"""Networks as edge tables (src, dst) and node tables (node, ...)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import pair, wrapped_list
from ..session import durable, stored
from .joins import in_either_end
from .positions import hash_positions, key_hash
from .vectors import cosine_join
from .windows import top_per_group


def undirected_edges(df: DataFrame, a: str, b: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Weighted edges (src < dst) per ``by``: sum of ``weight``, or rows per pair."""
    lo, hi = pair(F.col(a), F.col(b))
    total = F.count("*") if weight is None else F.sum(weight)
    return (
        df.where(F.col(a) != F.col(b))
        .groupBy(*by, lo.alias("src"), hi.alias("dst"))
        .agg(total.alias("weight"))
    )


def node_label(name: Column, period: Column, sep: str = " : ") -> Column:
    return F.concat_ws(sep, name.cast("string"), period.cast("string"))


class Bundle(NamedTuple):
    """Edges that hold in periods, a row for each pair of entities: src, dst, marks.

    ``periods`` is a calendar. Bit ``i % WORD`` of word ``i // WORD`` of ``marks`` says that the edge holds in
    period i, so a pair is shuffled once and not once for each period.
    """

    links: DataFrame
    periods: list


WORD = 62  # periods that a word of ``marks`` holds


def _placed(rows: DataFrame, period: str, periods: list) -> DataFrame:
    """Adds ``_at``, the place of the period in the calendar; rows of other periods are left out."""
    known = F.array(*[F.lit(p) for p in periods], F.lit(None)).cast(f"array<{rows.schema[period].dataType.simpleString()}>")
    return rows.withColumn("_at", (F.array_position(known, F.col(period)) - 1).cast("int")).where("_at >= 0")


def _united(rows: DataFrame, by: Sequence[str], periods: list) -> DataFrame:
    """One row per ``by``: the periods that any of its rows marks."""
    words = [F.bit_or(F.get("marks", F.lit(w))) for w in range(len(periods) // WORD + 1)]
    return rows.groupBy(*by).agg(F.array(*words).alias("marks"))


def _node_marks(nodes: DataFrame, entity: str, period: str, periods: list) -> DataFrame:
    """entity, marks: the periods in which an entity is a node."""
    words = [
        F.expr(f"bit_or(case when _at div {WORD} = {w} then shiftleft(1L, _at % {WORD}) else 0L end)")
        for w in range(len(periods) // WORD + 1)]
    rows = _placed(nodes.select(F.col(entity).alias("entity"), period), period, periods).where("entity is not null")
    return rows.groupBy("entity").agg(F.array(*words).alias("marks"))


def _bundle_ends(bundle: Bundle) -> DataFrame:
    """entity, marks: the periods in which an entity is an end of an edge."""
    ends = bundle.links.select(F.explode(F.array("src", "dst")).alias("entity"), "marks")
    return _united(ends, ["entity"], bundle.periods)


def extend_over_periods(edges: DataFrame, period: str, bundled: bool = False) -> DataFrame | Bundle:
    """Give each directed link every period of the table.

    The distinct periods are one array (a calendar, not data) found by a one-row
    aggregate, so nothing is joined: each distinct link is exploded once, or marks them all.
    """
    periods = edges.agg(F.sort_array(F.collect_set(period)).alias("p"))
    links = edges.select("src", "dst").distinct()
    if not bundled:
        return links.withColumn("_p", periods.scalar()).select("src", "dst", F.explode("_p").alias(period))
    found = periods.first()["p"]
    words = [2 ** max(0, min(WORD, len(found) - at)) - 1 for at in range(0, len(found) + 1, WORD)]
    return Bundle(links.withColumn("marks", F.array(*[F.lit(w).cast("long") for w in words])), found)


def in_both(bundle: Bundle, nodes: DataFrame, entity: str, period: str) -> Bundle:
    """The edges in the periods in which both ends are nodes."""
    own = _node_marks(nodes, entity, period, bundle.periods)
    links = bundle.links
    for end in ("dst", "src"):
        links = links.join(own.select(F.col("entity").alias(end), F.col("marks").alias("_own")), end)
        links = links.select("src", "dst", F.zip_with("marks", "_own", lambda a, b: a.bitwiseAND(b)).alias("marks"))
        links = links.where("exists(marks, m -> m <> 0)")
    return Bundle(links, bundle.periods)


def in_either_end_of(nodes: DataFrame, bundle: Bundle, entity: str, period: str) -> DataFrame:
    """Nodes that are an end of an edge in their period."""
    ends = _bundle_ends(bundle).withColumnsRenamed({"entity": entity, "marks": "_marks"})
    rows = _placed(nodes, period, bundle.periods).join(ends, entity)
    return rows.where(f"shiftright(_marks[_at div {WORD}], _at % {WORD}) % 2 = 1").select(*nodes.columns)


def resolve_edges(edges: DataFrame | Bundle, nodes: DataFrame, entity: str, period: str) -> DataFrame:
    """Edges between entities per period to edges between nodes; both ends must exist.

    A bundle meets the nodes of each entity as a list, as long as the calendar; only the result has a row per period.
    """
    if isinstance(edges, Bundle):
        rows = _placed(nodes.select(F.col(entity).alias("entity"), period, "node"), period, edges.periods)
        named = rows.groupBy("entity").agg(F.collect_list(F.struct(F.col("_at").alias("at"), "node")).alias("nodes"))
        both = edges.links
        for end in ("src", "dst"):
            both = both.join(named.select(F.col("entity").alias(end), F.col("nodes").alias(f"_{end}")), end)
        marked = f"x -> shiftright(marks[x.at div {WORD}], x.at % {WORD}) % 2 = 1"
        pairs = F.expr(
            f"flatten(transform(filter(_src, {marked}), "
            "a -> transform(filter(_dst, b -> b.at = a.at), b -> named_struct('src', a.node, 'dst', b.node))))")
        return both.select(F.inline(pairs))
    src = nodes.select(F.col(entity).alias("src"), period, F.col("node").alias("_src"))
    dst = nodes.select(F.col(entity).alias("dst"), period, F.col("node").alias("_dst"))
    both = edges.join(src, ["src", period]).join(dst, ["dst", period])
    return both.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))


def prune(
    nodes: DataFrame, edges: DataFrame | Bundle, label: str, split: str, entity: str = "entity", period: str = "period",
) -> tuple[DataFrame, DataFrame | Bundle]:
    """One round of joint pruning.

    Nodes with an edge; of these the classes with more than one training node; edges
    whose ends survive; nodes that still have an edge. Edges and linked nodes are read
    several times, so they are written. Edges in a bundle stay one: there a node
    is an entity in a period, and nodes have these columns.
    """
    bundled = isinstance(edges, Bundle)
    if bundled:
        edges = Bundle(stored(edges.links, "edges"), edges.periods)
        linked = stored(in_either_end_of(nodes, edges, entity, period), "linked")
    else:
        edges = stored(edges, "edges")
        linked = stored(in_either_end(nodes, edges), "linked")
    trained = linked.groupBy(label).agg(F.count_if(F.col(split) == "train").alias("_n")).where("_n > 1")
    kept = linked.join(trained.select(label), label, "left_semi").select(*linked.columns)
    if bundled:
        edges = in_both(edges, kept, entity, period)
        return in_either_end_of(kept, edges, entity, period), edges
    edges = induced(edges, kept)
    return in_either_end(kept, edges), edges


def encode_nodes(nodes: DataFrame, node: str = "node", out: str = "node_int") -> DataFrame:
    """Dense integer code 0..n-1 per distinct node, in md5 order."""
    return hash_positions(nodes.select(node).distinct(), [node], out=out)


def _one_way(edges: DataFrame) -> DataFrame:
    """Edges with their ends in a fixed order, a null end first."""
    turned = (F.col("dst") < F.col("src")) | (F.col("dst").isNull() & F.col("src").isNotNull())
    ends = {"src": F.when(turned, F.col("dst")).otherwise(F.col("src")), "dst": F.when(turned, F.col("src")).otherwise(F.col("dst"))}
    return edges.select(*[ends.get(c, F.col(c)).alias(c) for c in edges.columns])


def symmetrise(edges: DataFrame) -> DataFrame:
    """Distinct edges in both directions; each pair is shuffled once and turned afterwards."""
    pairs = _one_way(edges.select("src", "dst")).distinct()
    there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pairs.select(F.inline(F.when(F.col("src").eqNullSafe(F.col("dst")), F.array(there)).otherwise(F.array(there, back))))


def degree_stats(edges: DataFrame | Bundle) -> DataFrame:
    """Edges, connected nodes and mean degree of the symmetrised edge set: one row."""
    if isinstance(edges, Bundle):
        bits = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))
        pairs = _united(_one_way(edges.links), ["src", "dst"], edges.periods)
        ways = F.when(F.col("src") == F.col("dst"), 1).otherwise(2)
        total = pairs.agg(F.sum(bits("marks") * ways).alias("directed_edges"))
        return _bundle_ends(edges).agg(F.coalesce(F.sum(bits("marks")), F.lit(0)).alias("nodes")).crossJoin(total).withColumn(
            "mean_degree", F.try_divide(F.col("directed_edges").cast("double"), F.col("nodes")))
    degrees = symmetrise(edges).groupBy("src").agg(F.count("*").alias("_d"))
    return degrees.agg(
        F.count("*").alias("nodes"),
        F.sum("_d").alias("directed_edges"),
        F.avg("_d").alias("mean_degree"),
    )


def top_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """The k heaviest neighbours of each node as an ordered list and a wrapped text.

    Weights of both directions are added per pair, before the pair is turned. Ranking keeps at
    most k rows per node on the map side, so a hub is never gathered.
    """
    pairs = _one_way(edges.select("src", "dst", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    turned = lambda a, b, w: F.struct(F.col(a).alias("node"), F.col(b).alias("other"), w.alias("weight"))
    once = F.array(turned("src", "dst", F.col("weight") * 2))
    both = F.array(turned("src", "dst", F.col("weight")), turned("dst", "src", F.col("weight")))
    total = pairs.select(F.inline(F.when(F.col("src").eqNullSafe(F.col("dst")), once).otherwise(both)))
    best = top_per_group(total, ["node"], [F.desc("weight"), F.asc("other")], k)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "other")))
    names = F.transform(ordered, lambda x: x["other"].cast("string"))
    return best.groupBy("node").agg(names.alias("neighbours")).withColumn(
        "neighbour_text", wrapped_list(F.col("neighbours"))
    )


def sample_nodes(nodes: DataFrame, share: float, seed: int, node: str = "node") -> DataFrame:
    """Nodes whose hash falls below the share; the same nodes in every run."""
    cut = f"{math.floor(share * 16**8):08x}"
    return nodes.where(F.substring(key_hash(node, seed=seed), 1, 8) < cut)


def induced(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges with both ends among the nodes."""
    kept = edges
    for end in ("src", "dst"):
        kept = kept.join(nodes.select(F.col(node).alias(end)), end, "left_semi")
    return kept.select(*edges.columns)


# ---------------------------------------------------------------- similarity graph

def similarity_edges(
    vectors: DataFrame,
    id_: str,
    vec: str,
    quantile: float | None = 0.98,
    at_least: float | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Pairs (src < dst) with cosine at or above a threshold or a quantile of all pairs, exactly: ``vectors.cosine_join``.

    Null vectors and those of length zero have no direction: they take no part.
    """
    return cosine_join(vectors, id_, vec, quantile, at_least, block_rows)


# ---------------------------------------------------------------- neighbourhood features


def neighbour_aggregate(
    nodes: DataFrame,
    edges: DataFrame,
    cols: Sequence[str],
    hops: int = 1,
    how: str = "max",
    node: str = "node",
) -> DataFrame:
    """Own features beside the elementwise max or mean over in-neighbours, hop after hop.

    Hop h aggregates the output of hop h-1, which is checkpointed so that neither the
    plan nor a lost executor repeats earlier hops. Nodes without in-neighbours get null.
    """
    agg = {"max": F.max, "mean": F.avg}[how]
    current, latest = nodes, list(cols)
    for hop in range(1, hops + 1):
        new = [f"{c}_{how}{hop}" for c in cols]
        source = current.select(F.col(node).alias("src"), *latest)
        pooled = (
            edges.select("src", "dst")
            .join(source, "src")
            .groupBy("dst")
            .agg(*[agg(c).alias(n) for c, n in zip(latest, new)])
            .withColumnRenamed("dst", node)
        )
        current, latest = current.join(pooled, node, "left"), new
        if hop < hops:
            current = durable(current)
    return current
