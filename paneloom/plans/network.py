"""Mention and similarity networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from .base import query

# A "document" is an order; it mentions the suppliers and the customer's nation. Two
# suppliers are linked by the orders that the one with the smaller key opens (line 1).
_SQL_MENTIONS = """mentions as (
    select o_custkey as a, l_suppkey as b, cast(date_trunc('year', o_orderdate) as date) as period, count(*) as n
    from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3)"""


def mention_rows(t):
    li, o = t.lineitem.select("l_orderkey", "l_suppkey"), t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .groupBy(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b"),
                 F.trunc(F.to_date("o_orderdate"), "year").alias("period"))
        .agg(F.count("*").alias("n")))


_SQL_EDGES = f"""{_SQL_MENTIONS}, edges as (
    select least(a, b) as src, greatest(a, b) as dst, cast(sum(n) as bigint) as weight from mentions where a <> b group by 1, 2)"""


def edges(t):
    return gr.undirected_edges(mention_rows(t), "a", "b", weight=F.col("n"))


@query("gr1_undirected_edges", f"with {_SQL_EDGES} select src, dst, weight from edges")
def _(t):
    return edges(t)


@query("gr2_temporal_edges", f"""
    with {_SQL_MENTIONS}
    select concat(least(a, b), ':', period) as src, concat(greatest(a, b), ':', period) as dst, count(*) as weight
    from mentions where a <> b group by 1, 2""")
def _(t):
    e = gr.undirected_edges(mention_rows(t), "a", "b", ["period"])
    return e.select(gr.node_label(F.col("src"), F.col("period"), ":").alias("src"),
                    gr.node_label(F.col("dst"), F.col("period"), ":").alias("dst"), "weight")


_SQL_LINKS = """links as (
    select distinct o_custkey as src, l_suppkey as dst, cast(date_trunc('year', o_orderdate) as date) as period
    from lineitem join orders on l_orderkey = o_orderkey where l_suppkey <> o_custkey)"""


def links(t):
    li, o = t.lineitem.select("l_orderkey", "l_suppkey"), t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.trunc(F.to_date("o_orderdate"), "year").alias("period"))
        .where("src <> dst").distinct())


_SQL_EXTENDED = f"{_SQL_LINKS}, extended as (select src, dst, p.period from (select distinct src, dst from links), (select distinct period from links) p)"


@query("gr3_extend_over_periods", f"with {_SQL_EXTENDED} select src, dst, period from extended")
def _(t):
    return gr.extend_over_periods(links(t), "period")


_SQL_NODES = """nodes as (
    select distinct o_custkey as entity, cast(date_trunc('year', o_orderdate) as date) as period,
        concat(o_custkey, ' : ', cast(date_trunc('year', o_orderdate) as date)) as node from orders)"""
_SQL_RESOLVED = f"""{_SQL_EXTENDED}, {_SQL_NODES}, resolved as (
    select a.node as src, b.node as dst from extended e join nodes a on e.src = a.entity and e.period = a.period
    join nodes b on e.dst = b.entity and e.period = b.period)"""


def nodes(t):
    n = t.orders.select(
        F.col("o_custkey").alias("entity"), F.trunc(F.to_date("o_orderdate"), "year").alias("period")).distinct()
    return n.withColumn("node", gr.node_label(F.col("entity"), F.col("period")))


def extended(t):
    return gr.extend_over_periods(links(t), "period", bundled=True)


def resolved(t):
    """The edges in the periods in which both ends are nodes, still in a bundle."""
    return gr.in_both(extended(t), nodes(t), "entity", "period")


@query("gr4_resolve_edges", f"with {_SQL_RESOLVED} select src, dst from resolved")
def _(t):
    return gr.resolve_edges(extended(t), nodes(t), "entity", "period")


# Class: nation of the customer and last digit of its key; split by hash of the node.
_SQL_PRUNED = f"""{_SQL_LINKS}, {_SQL_NODES},
    pairs as materialized (select distinct src, dst from links), periods as (select distinct period from links),
    resolved as materialized (select a.node as src, b.node as dst from pairs cross join periods p
        join nodes a on src = a.entity and p.period = a.period join nodes b on dst = b.entity and p.period = b.period),
    features as materialized (select node, entity, concat(c_nationkey, '-', entity % 10) as label,
        case when ('0x' || substr(md5('0|' || node), 1, 8))::bigint / 4294967296.0 < 0.8 then 'train' else 'test' end as split
        from nodes join customer on entity = c_custkey),
    ends as materialized (select src as node from resolved union select dst from resolved),
    f1 as materialized (select features.* from features join ends using (node)),
    trained as (select label from f1 where split = 'train' group by label having count(*) > 1),
    f2 as materialized (select f1.* from f1 join trained using (label)),
    e2 as materialized (select r.src, r.dst from resolved r join f2 a on r.src = a.node join f2 b on r.dst = b.node),
    ends2 as materialized (select src as node from e2 union select dst from e2),
    f3 as (select f2.* from f2 join ends2 using (node))"""


def features(t):
    from ..operators.learning import split_flag

    c = t.customer.select(F.col("c_custkey").alias("entity"), "c_nationkey")
    return nodes(t).join(c, "entity").select(
        "node", "entity", "period", F.concat_ws("-", F.col("c_nationkey").cast("string"), (F.col("entity") % 10).cast("string")).alias("label"),
        split_flag(["node"]).alias("split"))


@query("gr5_prune_nodes", f"with {_SQL_PRUNED} select node, label, split from f3")
def _(t):
    return gr.prune(features(t), resolved(t), "label", "split")[0].select("node", "label", "split")


@query("gr5_prune_edges", f"with {_SQL_PRUNED} select src, dst from e2")
def _(t):
    _, e = gr.prune(features(t), resolved(t), "label", "split")
    return gr.resolve_edges(e, nodes(t), "entity", "period")


@query("gr6_node_codes", f"""
    with {_SQL_NODES} select node, row_number() over (order by md5('0|' || node), node) - 1 as node_int from nodes""")
def _(t):
    return gr.encode_nodes(nodes(t))


@query("gr7_network_stats", f"""
    with {_SQL_PRUNED}, sym as (select src, dst from e2 union select dst, src from e2), deg as (select src, count(*) as d from sym group by 1)
    select (select count(*) from f3 where split = 'train') as train_nodes, (select count(*) from f3 where split = 'test') as test_nodes,
        (select count(distinct label) from f3) as classes, count(*) as nodes, cast(sum(d) as bigint) as directed_edges, round(avg(d), 4) as mean_degree from deg""")
def _(t):
    n, e = gr.prune(features(t), resolved(t), "label", "split")
    per_split = n.agg(
        F.struct(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"),
                 F.countDistinct("label").alias("classes"))).scalar()
    s = gr.degree_stats(e).withColumn("_s", per_split)
    return s.select(F.col("_s.train").alias("train_nodes"), F.col("_s.test").alias("test_nodes"), F.col("_s.classes").alias("classes"),
                    "nodes", "directed_edges", F.round("mean_degree", 4).alias("mean_degree"))


@query("gr8_top_neighbours", f"""
    with {_SQL_EDGES}, both_ways as (select src as node, dst as other, weight from edges union all select dst, src, weight from edges),
    r as (select *, row_number() over (partition by node order by weight desc, other) as k from both_ways),
    l as (select node, list(cast(other as varchar) order by k) as x from r where k <= 5 group by node)
    select node, array_to_string(x, ',') as neighbours,
        case when len(x) > 2 then concat(array_to_string(x[1:2], ', '), ',' || chr(10), array_to_string(x[3:], ', ')) else array_to_string(x, ', ') end as neighbour_text from l""")
def _(t):
    return gr.top_neighbours(edges(t), 5).withColumn("neighbours", F.array_join("neighbours", ","))


@query("gr9_similarity_edges", """
    with pairs as (select a.vec_id as src, b.vec_id as dst, list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) as s
        from embeddings a join embeddings b on a.vec_id < b.vec_id)
    select src, dst, round(s, 6) as similarity from pairs where s >= (select quantile_cont(s, 0.98) from pairs)""")
def _(t):
    e = gr.similarity_edges(t.embeddings, "vec_id", "embedding", 0.98)
    return e.withColumn("similarity", F.round("similarity", 6))


@query("gr10_enrich_nodes", """
    with n as (select l_suppkey as node from lineitem union select o_custkey from orders)
    select node, coalesce(s_name, cast(node as varchar)) as name, n_name as sector from n
    left join supplier on node = s_suppkey left join nation on s_nationkey = n_nationkey""")
def _(t):
    n = t.lineitem.select(F.col("l_suppkey").alias("node")).union(t.orders.select("o_custkey")).distinct()
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("node"), "s_name", F.col("n_name").alias("sector"))
    return n.join(s, "node", "left").select("node", F.coalesce("s_name", F.col("node").cast("string")).alias("name"), "sector")


@query("gr11_sampled_subgraph", f"""
    with {_SQL_LINKS}, e as (select distinct src, dst from links), n as (select src as node from e union select dst from e),
    s as (select node from n where substr(md5('3|' || node), 1, 8) < '80000000')
    select src, dst from e where src in (select node from s) and dst in (select node from s)""")
def _(t):
    e = links(t).select("src", "dst").distinct()
    n = e.select(F.col("src").alias("node")).union(e.select(F.col("dst"))).distinct()
    return gr.induced(e, gr.sample_nodes(n, 0.5, seed=3))


_SQL_POOL = f"""{_SQL_LINKS}, e as (select distinct src, dst from links),
    base as (select c_custkey as node, c_acctbal as x, cast(c_nationkey as double) as y from customer),
    h1 as (select dst as node, max(x) as x1, max(y) as y1 from e join base on src = node group by 1),
    h2 as (select dst as node, max(x1) as x2, max(y1) as y2 from e left join h1 on src = h1.node join base b on src = b.node group by 1)"""


def _base(t):
    return t.customer.select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))


def _directed(t):
    return links(t).select("src", "dst").distinct()


@query("gr12_neighbour_max", f"""
    with {_SQL_POOL} select base.node, x, y, x1 as x_max1, y1 as y_max1, x2 as x_max2, y2 as y_max2
    from base left join h1 on base.node = h1.node left join h2 on base.node = h2.node""")
def _(t):
    return gr.neighbour_aggregate(_base(t), _directed(t), ["x", "y"], hops=2)


@query("gr12_neighbour_mean", f"""
    with {_SQL_POOL}, m as (select dst as node, round(avg(x), 8) as x_mean1 from e join base on src = node group by 1)
    select base.node, x_mean1 from base left join m on base.node = m.node""")
def _(t):
    out = gr.neighbour_aggregate(_base(t).drop("y"), _directed(t), ["x"], how="mean")
    return out.select("node", F.round("x_mean1", 8).alias("x_mean1"))


@query("gr13_inductive_view", f"""
    with {_SQL_POOL}, seen as (select node from base where ('0x' || substr(md5('0|' || node), 1, 8))::bigint / 4294967296.0 < 0.8),
    inner_edges as (select * from e where src in (select node from seen) and dst in (select node from seen)),
    fitted as (select dst as node, max(x) as x_max from inner_edges join base on src = node group by 1),
    applied as (select dst as node, max(x) as x_max from e join base on src = node group by 1)
    select 'train' as view, s.node, x_max from seen s left join fitted on s.node = fitted.node
    union all select 'full', b.node, x_max from base b left join applied on b.node = applied.node""")
def _(t):
    from ..operators.learning import split_flag

    base, e = _base(t).drop("y"), _directed(t)
    train = base.where(split_flag(["node"]) == "train")
    views = (("train", train, gr.induced(e, train)), ("full", base, e))
    parts = [
        gr.neighbour_aggregate(n, ed, ["x"]).select(F.lit(v).alias("view"), "node", F.col("x_max1").alias("x_max"))
        for v, n, ed in views]
    return parts[0].union(parts[1])
