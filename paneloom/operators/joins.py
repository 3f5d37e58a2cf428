"""Joins. Sides are broadcast only after Spark measured their size (file statistics of stored
tables, shuffle statistics under AQE). A side too big for that is sort-merge joined, with AQE
splitting hot keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.arrays import char_grams
from ..functions.dates import MonthGrid
from ..session import stored
from .positions import ordered_positions


def suffix_shared(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> dict[str, DataFrame]:
    """Suffix non-key columns that occur in more than one table with the table's name."""
    seen: dict[str, int] = {}
    for df in tables.values():
        for c in df.columns:
            seen[c] = seen.get(c, 0) + 1
    return {
        name: df.withColumnsRenamed(
            {c: f"{c}_{name}" for c in df.columns if c not in keys and seen[c] > 1}
        )
        for name, df in tables.items()
    }


def fold_inner(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Inner join of all tables on the same keys, shared names suffixed."""
    return reduce(lambda a, b: a.join(b, list(keys)), suffix_shared(tables, keys).values())


def audited_fold(base: DataFrame, steps: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> tuple[DataFrame, DataFrame]:
    """Inner joins of ``base`` with one table after another, and an audit of what each step did.

    steps: (name, table, keys). The audit has a row for each step: rows before and after, rows
    lost, and how many keys of the table occur more than once (they would multiply rows). The joins
    run once, as outer joins with a flag for each table, into a written table; one aggregate
    of the flags then gives all counts, and the rows with all flags are the result.
    """
    rows, repeated = base, []
    for i, (_, table, keys) in enumerate(steps):
        rows = rows.join(table.withColumn(f"_in_{i}", F.lit(True)), list(keys), "left")
        repeated.append(table.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.count("*")).scalar())
    rows = stored(rows, "fold")
    flags = [F.coalesce(F.col(f"_in_{i}"), F.lit(False)) for i in range(len(steps))]
    upto = [reduce(lambda a, b: a & b, flags[:i], F.lit(True)) for i in range(len(steps) + 1)]
    counts = rows.agg(*[F.count_if(u).alias(f"n{i}") for i, u in enumerate(upto)])
    lines = [
        F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("joined"), F.col(f"n{i}").alias("rows_in"), F.col(f"n{i + 1}").alias("rows_out"),
                 (F.col(f"n{i}") - F.col(f"n{i + 1}")).alias("lost"), F.col(f"r{i}").alias("repeated_keys"))
        for i, (name, _, _) in enumerate(steps)]
    audit = counts.withColumns({f"r{i}": r for i, r in enumerate(repeated)}).select(F.inline(F.array(*lines)))
    return rows.where(upto[-1]).drop(*[f"_in_{i}" for i in range(len(steps))]), audit


def flagged_full_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], flags: tuple[str, str]
) -> DataFrame:
    """Full outer join with one 0/1 origin flag per side."""
    joined = left.withColumn(flags[0], F.lit(1)).join(
        right.withColumn(flags[1], F.lit(1)), list(keys), "full_outer"
    )
    return joined.fillna(0, subset=list(flags))


def interval_join(
    history: DataFrame,
    valid_from: str,
    valid_to: str,
    grid: MonthGrid,
    closed: str = "left",
    out: str = "grid_date",
) -> DataFrame:
    """One row per history row and grid date inside its validity interval.

    The grid dates of a row follow from its own bounds, so nothing is joined.
    ``closed="left"`` takes ``from <= g < to``; ``"both"`` takes ``from <= g <= to``.
    """
    first = F.greatest(grid.ceil_index(F.col(valid_from)), F.lit(0))
    if closed == "both":
        last = grid.floor_index(F.col(valid_to))
    else:
        last = grid.ceil_index(F.col(valid_to)) - 1
    last = F.least(last, F.lit(grid.last_index))
    known = F.col(valid_from).isNotNull() & F.col(valid_to).isNotNull()
    indexes = F.when(known & (first <= last), F.sequence(first, last))
    return (
        history.withColumn("_i", F.explode(indexes))
        .withColumn(out, grid.point(F.col("_i")))
        .drop("_i")
    )


def asof_join(
    left: DataFrame,
    events: DataFrame,
    on: Sequence[str],
    grid_col: str,
    event_time: str,
    tie: Sequence[str],
    grid: MonthGrid,
    how: str = "inner",
) -> DataFrame:
    """Latest event per key in ``[previous grid date, grid date)``.

    Events are reduced to one row per key and grid date before any join, with a
    partial aggregate on the map side, so a key with many events costs one row per
    period and the join itself is an equality join.
    """
    payload = [c for c in events.columns if c not in on]
    dated = events.withColumn("_g", grid.point(grid.floor_index(F.col(event_time)) + 1))
    if payload == [event_time]:  # a bare date stays in the hash aggregate
        latest = dated.groupBy(*on, "_g").agg(F.max(event_time).alias(event_time))
    else:
        best = F.max_by(F.struct(*payload), F.struct(event_time, *tie)).alias("_event")
        latest = dated.groupBy(*on, "_g").agg(best).select(*on, "_g", "_event.*")
    latest = latest.withColumnRenamed("_g", grid_col)
    return left.join(latest, [*on, grid_col], how)


def previous_period(
    panel: DataFrame,
    key: str,
    period: str,
    previous: str,
    cols: Sequence[str],
    suffix: str = "_diff",
) -> DataFrame:
    """``value - value one period earlier``; null where that period is missing.

    ``panel`` is unique on (key, period): the window of a key holds one row per
    period, so its size is the length of the grid and not the size of the data.
    """
    w = Window.partitionBy(key).orderBy(period)
    adjacent = F.lag(period).over(w) == F.col(previous)
    return panel.withColumns(
        {c + suffix: F.col(c) - F.when(adjacent, F.lag(c).over(w)) for c in cols}
    )


def lookup_ends(
    edges: DataFrame,
    dim: DataFrame,
    dim_key: str,
    ends: Sequence[str] = ("src", "dst"),
    how: str = "left",
) -> DataFrame:
    """Resolve each end of an edge against the same dimension; columns get the end as prefix."""
    for end in ends:
        renamed = dim.withColumnsRenamed(
            {c: (end if c == dim_key else f"{end}_{c}") for c in dim.columns}
        )
        edges = edges.join(renamed, end, how)
    return edges


def match_not_self(left: DataFrame, right: DataFrame, name: tuple[str, str], key: tuple[str, str]) -> DataFrame:
    """Equality match on a name, rows that match their own key left out."""
    same = left[name[0]] == right[name[1]]
    return left.join(right, same & (left[key[0]] != right[key[1]]))


def in_either_end(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Nodes that occur as source or destination of an edge."""
    ends = edges.select(F.col("src").alias(node)).union(edges.select(F.col("dst").alias(node)))
    return nodes.join(ends.distinct(), node, "left_semi")


def key_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys on each side and in common, and whether they are unique: one row."""
    counted = (
        left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .union(right.select(key, F.lit(0), F.lit(1)))
        .groupBy(key)
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    )
    return counted.agg(
        F.count_if(F.col("l") > 0).alias("left_keys"),
        F.count_if(F.col("r") > 0).alias("right_keys"),
        F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("common_keys"),
        (F.max("l") <= 1).alias("left_unique"),
        (F.max("r") <= 1).alias("right_unique"),
    )


HOT_GRAM = 4000  # names with a key of rarest grams, from which on the key takes one more gram, or in the end is split by size
MOST_GRAMS = 4  # of a key
END = -1  # in a key: the names have no further gram in common


def name_grams(df: DataFrame, c: str, n: int) -> DataFrame:
    """Each distinct name and its set of grams."""
    known = df.select(F.col(c).alias("name")).where(F.col("name").isNotNull()).distinct()
    return known.withColumn("grams", char_grams(F.col("name"), n))


def gram_frequency(*named: DataFrame) -> DataFrame:
    """gram, freq, id: how many names of all tables hold it, and its place among all grams by that number, then by itself."""
    every = [d.select(F.explode("grams").alias("gram")) for d in named]
    counts = reduce(DataFrame.unionAll, every).groupBy("gram").agg(F.count("*").alias("freq"))
    return ordered_positions(counts, ["freq", "gram"], "id").withColumn("id", F.col("id").cast("int"))


def gram_sets(grams: DataFrame, threshold: float, frequency: DataFrame) -> DataFrame:
    """name, size, ids (rarest first), freqs, spare, marks_0, marks_1, of name, grams.

    spare: how many grams may be missing in a partner. marks: a bit for each id modulo 128.
    """
    ranked = (
        grams.select("name", F.explode("grams").alias("gram")).join(frequency, "gram")
        .groupBy("name").agg(F.sort_array(F.collect_list(F.struct("id", "freq"))).alias("g"))
    )
    sets = ranked.select("name", F.size("g").alias("size"), F.col("g.id").alias("ids"), F.col("g.freq").alias("freqs"))
    mark = "aggregate(ids, 0L, (marks, i) -> marks | if((shiftright(i, 6) & 1) = {}, shiftleft(1L, i & 63), 0L))"
    return sets.withColumns({
        "spare": F.col("size") - F.ceil(F.col("size") * threshold - 1e-6).cast("int"),
        "marks_0": F.expr(mark.format(0)), "marks_1": F.expr(mark.format(1))})


def longer_keys(rows: DataFrame, level: int) -> DataFrame:
    """The rows with keys of ``level`` grams, from those with one gram less: path, last (the place of its last gram), gram (a number for path).

    Two names that can match have so many grams in common that the ``level`` rarest of these are among the
    first ``spare + level`` of each (a single gram is taken from one more). ``END`` stands for no further gram, where so few may be enough.
    """
    last = F.least(F.col("spare") + max(level - 1, 1), F.col("size") - 1)
    more = F.slice("ids", F.col("last") + 2, last - F.col("last"))
    end = F.when(F.col("size") - F.col("spare") < level, F.array(F.lit(END))).otherwise(F.array().cast("array<int>"))
    out = rows.drop("gram").select("*", F.posexplode(F.concat(more, end)).alias("_step", "_id"))
    return out.withColumns({
        "path": F.concat("path", F.array("_id")),
        "last": F.col("last") + 1 + F.col("_step")}).withColumn("gram", F.xxhash64("path")).drop("_step", "_id")


def ranked_grams(df: DataFrame, c: str, threshold: float, n: int, frequency: DataFrame | None = None) -> DataFrame:
    """The rows of the distinct names with keys of one gram (see ``longer_keys``), and freq, how many names hold it anywhere."""
    grams = name_grams(df, c, n)
    return first_keys(gram_sets(grams, threshold, frequency if frequency is not None else gram_frequency(grams)))


def first_keys(sets: DataFrame) -> DataFrame:
    rows = longer_keys(sets.withColumns({"path": F.array().cast("array<int>"), "last": F.lit(-1)}), 1)
    return rows.withColumn("freq", F.get("freqs", F.col("last"))).drop("freqs")


def refined(x: DataFrame, y: DataFrame, hot: int, most: int = MOST_GRAMS) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides with longer keys where a key has ``hot`` names or more; freq is then the number of rows of a key.

    A pair still meets at one key that starts with its rarest common grams, which both sides lengthen alike.
    """
    rows, done = (x, y), []
    for level in range(2, most + 1):
        long = (F.col("freq") >= hot) & (F.element_at("path", -1) != END)
        done.append([r.where(~long) for r in rows])
        rows = [longer_keys(r.where(long).drop("freq"), level) for r in rows]
        keys = reduce(DataFrame.unionAll, [r.select("gram") for r in rows])
        crowded = stored(keys.groupBy("gram").agg(F.count("*").alias("freq")).where(F.col("freq") >= hot), "crowded")
        if crowded.isEmpty():
            rows = [r.withColumn("freq", F.lit(0).cast("long")) for r in rows]
            break
        rows = [r.join(crowded, "gram", "left").withColumn("freq", F.coalesce("freq", F.lit(0))) for r in rows]
    done.append(rows)
    return tuple(reduce(DataFrame.unionByName, side) for side in zip(*done))


def gram_groups(x: DataFrame, y: DataFrame, threshold: float, hot: int = HOT_GRAM) -> tuple[DataFrame, DataFrame]:
    """The rows that meet, with their key (gram, cell): a gram of ``hot`` names or more has a cell for each size.

    Sizes of a pair lie within the factor ``threshold``. So the right rows of a hot gram stay in the cell
    of their own size, and a left row visits the cells of the sizes that it can match.
    """
    low, high = F.ceil(F.col("size") * threshold - 1e-6).cast("int"), F.floor(F.col("size") / threshold + 1e-6).cast("int")
    cells = F.when(F.col("freq") >= hot, F.sequence(low, high)).otherwise(F.array(F.lit(0)))
    left = x.withColumn("cell", F.explode(cells)).drop("freq")
    right = y.withColumn("cell", F.when(F.col("freq") >= hot, F.col("size")).otherwise(0)).drop("freq")
    return left, right


def fuzzy_best_match(
    left: DataFrame,
    right: DataFrame,
    left_col: str,
    right_col: str,
    threshold: float = 0.7,
    n: int = 3,
    not_equal: bool = False,
    hot: int = HOT_GRAM,
) -> DataFrame:
    """Best partner of each distinct left name by character n-gram Jaccard similarity.

    Exact set-similarity join. Grams are ordered by how many names contain them; two sets with
    similarity >= t must share one of the ``size - ceil(t * size) + 1`` rarest grams of
    each, their two rarest common grams are among one more of each, and so on; their sizes lie
    within a factor t. Only such rare grams are joined on: one, or where too many names hold it, two and more.
    Where two names meet, what stands behind the shared grams in each bounds what they can have in
    common (positional filter), and so do 128 bits of each set, of which a missing gram can only change one.
    Pairs that still can reach the threshold are compared there, on whole sets of gram numbers, and only
    where they share their rarest common grams. So a pair comes out once
    and only if it matches: candidates are never shuffled.
    Copies of a name are reduced to one before matching; join the result back by name.
    """
    named = [stored(name_grams(df, c, n).select("name"), "names") for df, c in ((left, left_col), (right, right_col))]
    named = [name_grams(df, "name", n) for df in named]
    frequency = stored(gram_frequency(*named), "grams")
    sets = [stored(gram_sets(df, threshold, frequency), "sets") for df in named]
    x, y = gram_groups(*refined(*[first_keys(s) for s in sets], hot), threshold, hot)
    level = F.size("path")
    reach = F.when(F.element_at("path", -1) == END, level - 1).otherwise(level - 1 + F.col("size") - F.col("last"))  # in common at most
    kept = ["gram", "cell", "name", "size", "marks_0", "marks_1", reach.alias("reach"), "ids"]
    x = x.select(*kept, level.alias("level"))
    y = y.select(*kept).withColumnsRenamed({c: f"_{c}" for c in ("name", "size", "marks_0", "marks_1", "reach", "ids")})
    total = F.col("size") + F.col("_size")
    unlike = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in ("marks_0", "marks_1"))
    may = (F.least("size", "_size") >= F.greatest("size", "_size") * threshold - 1e-6) \
        & (F.least("reach", "_reach") >= total * (threshold / (1 + threshold)) - 1e-6) \
        & (unlike <= total * ((1 - threshold) / (1 + threshold)) + 1e-6)
    if not_equal:
        may &= F.col("name") != F.col("_name")
    shared = F.array_intersect("ids", "_ids")
    common = F.size(shared)
    similarity = common / (total - common)
    own = F.xxhash64(F.slice(F.concat(shared, F.array(F.lit(END))), F.lit(1), F.col("level"))) == F.col("gram")
    met = x.join(y, ["gram", "cell"]).where(may & (similarity >= threshold) & own)
    pairs = met.select(F.col("name").alias(left_col), F.col("_name").alias(right_col), similarity.alias("similarity"))
    best = Window.partitionBy(left_col).orderBy(F.desc("similarity"), right_col)
    return pairs.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
