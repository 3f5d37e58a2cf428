"""Splits, classifiers, metrics and model comparison on the document labels and orders."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.arrays import widen
from ..operators import learning as ml
from ..operators import metrics as mt
from ..operators import moments as mo
from ..operators import text as tx
from ..operators.windows import average_rank
from ..session import stored
from .base import query, scratch
from .standins import GRADE_RANK, SQL_RANK, sql_tokens, sql_words
from .texts import NUM, SENT

_UNIFORM = "(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::bigint / 4294967296.0)"

# ---------------------------------------------------------------- rule-based predictions
# Three rules predict the priority of an order; one row per model and order.
_CLASSES = ("URGENT", "HIGH", "MEDIUM", "LOW", "NOT SPECIFIED")
_RULES = {
    "size": "case when o_totalprice < 100000 then 'LOW' when o_totalprice < 250000 then 'MEDIUM' when o_totalprice < 400000 then 'HIGH' else 'URGENT' end",
    "customer": "case o_custkey % 5 when 0 then 'URGENT' when 1 then 'HIGH' when 2 then 'MEDIUM' when 3 then 'LOW' else 'NOT SPECIFIED' end",
    "constant": "'HIGH'",
}
SQL_PREDICTIONS = "predictions as (\n    " + "\n    union all ".join(
    f"select '{m}' as model, o_orderkey, o_custkey, substr(o_orderpriority, 3) as truth, {r} as prediction from orders" for m, r in _RULES.items()
) + ")"


def predictions(t):
    """Long prediction table: the rules are exploded from one scan of the orders."""
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(r).alias("prediction")) for m, r in _RULES.items()])
    return t.orders.select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 3, 100).alias("truth"), F.inline(each))


# ---------------------------------------------------------------- splits and roles


@query("ml1_split_flag", f"""
    select o_orderkey, case when {_UNIFORM.format(seed=3, key="o_orderkey")} < 0.8 then 'train' else 'test' end as split from orders""")
def _(t):
    return t.orders.select("o_orderkey", ml.split_flag(["o_orderkey"], 0.8, 3).alias("split"))


@query("ml2_exact_holdout", """
    with r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by md5('5|' || o_orderkey), o_orderkey) - 1 as p,
        count(*) over (partition by o_orderpriority) as n from orders)
    select o_orderkey, o_orderpriority, case when p < floor(0.2 * n) then 'validation' else 'train' end as split from r""")
def _(t):
    return ml.exact_holdout(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"], seed=5)


REGISTER = (
    ml.Variable("quality", "categorical", {"text": "Y", "size": "Y"}),
    ml.Variable("word_count", "numeric", {"text": "X", "size": "X", "language": "X"}),
    ml.Variable("n_sentences", "numeric", {"text": "X", "size": "X", "language": "X"}),
    ml.Variable("num_transparency", "numeric", {"text": "X", "language": "X"}),
    ml.Variable("mean_sentence_length", "numeric", {"text": "X", "language": "X"}),
    ml.Variable("capital_run", "numeric", {"text": "X", "language": "X"}),
    ml.Variable("lang", "categorical", {"text": "X", "language": "Y"}),
    ml.Variable("toxic", "numeric", {"text": "X (Previous)", "size": "X (Previous)"}),
)


@query("ml3_selected_variables", f"""
    with k as (select doc_id, lang, len({sql_words()}) as word_count from documents)
    select doc_id, cast(quality as varchar) as quality, toxic, word_count from labels join k using (doc_id)""")
def _(t):
    register = [v for v in REGISTER if v.name in ("quality", "word_count", "toxic")]
    numeric, categorical, target = ml.select_roles(register, "size", include_previous=True)
    table = document_table(t).withColumn("word_count", F.col("word_count").cast("long"))
    return table.select("doc_id", target, *numeric, *categorical)


def document_table(t):
    """Labelled documents with their text features, split by hash."""
    d = t.documents.select("doc_id", "text")
    f = tx.text_features(d.join(t.labels, "doc_id", "left_semi"), "doc_id")
    attrs = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    table = f.join(attrs, "doc_id").withColumn("quality", F.col("quality").cast("string"))
    filled = table.fillna(0.0, subset=["mean_sentence_length", "num_transparency"])
    return filled.withColumn("split", ml.split_flag(["doc_id"], 0.8, 1))


def _design(t, model="text"):
    """Fitted design matrix, training and test rows (written, as every fit rereads them)."""
    numeric, categorical, target = ml.select_roles(REGISTER, model)
    table = stored(document_table(t).select("doc_id", "split", target, *numeric, *categorical), "design")
    train, test = table.where("split = 'train'"), table.where("split = 'test'")
    matrix = ml.design_matrix(numeric, categorical, target).fit(train)
    return matrix, train, test, target


# The labelled documents with their text features, as ``document_table`` makes them.
_SQL_TABLE = f"""labelled as (select doc_id, cast(quality as varchar) as quality, lang, text, {sql_tokens()} as ts, {sql_words()} as ws,
        len({SENT}) as n_sentences, case when {_UNIFORM.format(seed=1, key="doc_id")} < 0.8 then 'train' else 'test' end as split
        from documents join labels using (doc_id)),
    document_table as (select doc_id, quality, lang, split, len(ws) as word_count, n_sentences,
        coalesce(round(len([x for x in ts if regexp_matches(x, {NUM})]) / nullif(len(list_distinct([x for x in ts if not regexp_matches(x, {NUM})])), 0), 2), 0) as num_transparency,
        coalesce(len(ws) / nullif(n_sentences, 0), 0) as mean_sentence_length,
        coalesce(list_max([length(r) for r in regexp_extract_all(array_to_string([case when regexp_matches(w, $$^\\p{{Lu}}$$) then '1' else '0' end for w in ws], ''), '1+')]), 0) as capital_run
        from labelled)"""
_NUMBERS = ("word_count", "n_sentences", "num_transparency", "mean_sentence_length", "capital_run")
_SCALED = ", ".join(f"round(coalesce(({c} - m{i}) / nullif(s{i}, 0), 0), 6) as f{i}" for i, c in enumerate(_NUMBERS))


@query("ml4_design_matrix", f"""
    with {_SQL_TABLE}, fit as (select {", ".join(f"avg({c}) as m{i}, stddev_samp({c}) as s{i}" for i, c in enumerate(_NUMBERS))},
        list(distinct lang order by lang) as langs from document_table where split = 'train')
    select doc_id, split, {_SCALED}, {", ".join(f"case when lang = langs[{i + 1}] then 1.0 else 0.0 end::double as f{5 + i}" for i in range(4))}
    from document_table, fit""")
def _(t):
    matrix, train, test, _target = _design(t)
    out = matrix.transform(test.unionByName(train))
    names = ml.feature_names(out)
    values = out.select("doc_id", "split", F.transform(vector_to_array("features"), lambda x: F.round(x, 6)).alias("x"))
    return values.select("doc_id", "split", *widen(F.col("x"), len(names), "f"))


def _fitted_logistic(t, saved=False, **settings):
    """Fitted with balanced weights; ``saved``: a model that was saved for the same rows and settings is loaded."""
    matrix, train, test, target = _design(t)
    weighted = mt.with_balanced_weight(train, target)
    ready = ml.training_rows(matrix, weighted)
    settings = {"c": 1.0, "l1_ratio": 0.5, "weight": "weight"} | settings
    estimator = ml.elastic_net(train.count(), **settings)
    model = ml.fitted(estimator, ready, scratch(t, "models"), settings, key=weighted) if saved else estimator.fit(ready)
    return model, matrix, train, test, target


@query("ml5_elastic_net")
def _(t):
    model, matrix, _train, test, target = _fitted_logistic(t)
    return ml.score(model, matrix, test, ["doc_id"], target)


@query("ml5_one_vs_rest")
def _(t):
    model, matrix, _train, test, target = _fitted_logistic(t, one_vs_rest=True)
    return ml.score(model, matrix, test, ["doc_id"], target)


_FITS = {"ridge": {"c": 1.0, "l1_ratio": 0.0}, "mixed": {"c": 1.0, "l1_ratio": 0.5}, "lasso": {"c": 0.1, "l1_ratio": 1.0}}
RESIDUAL = 1e-3  # of the mean loss's gradient, on standardised features


@query("ml5_optimality", f"""
    with {_SQL_TABLE}, k as (select distinct quality as label from document_table where split = 'train')
    select model, label, cast(feature as integer) as feature, true as optimal
    from k, (select unnest({list(_FITS)}) as model), (select unnest(range(10)) as feature)""")
def _(t):
    matrix, train, _test, target = _design(t)
    weighted = mt.with_balanced_weight(train, target)
    ready, n = ml.training_rows(matrix, weighted), train.count()
    rows = []
    for name, settings in _FITS.items():
        model = ml.elastic_net(n, weight="weight", **settings).fit(ready)
        gaps = ml.optimality(model, ready, 1.0 / (settings["c"] * n), settings["l1_ratio"], "weight")
        rows += [(name, label, j, bool(gap <= RESIDUAL)) for label, gap_row in zip(ml.class_labels(matrix), gaps) for j, gap in enumerate(gap_row)]
    return t.spark.createDataFrame(rows, "model string, label string, feature int, optimal boolean")


@query("ml6_grid_search")
def _(t):
    matrix, train, _test, _target = _design(t)
    ready = stored(ml.training_rows(matrix, train).select("features", "label"), "grid")
    n = ready.count()
    strengths = [1.0 / (c * n) for c in (0.01, 1.0, 100.0)]
    found = ml.grid_search(ml.elastic_net(n, max_iter=20), {"regParam": strengths, "elasticNetParam": [0.0, 0.5, 1.0]}, ready, folds=5)
    rows = ml.grid_results(found, ["regParam", "elasticNetParam"])
    return t.spark.createDataFrame(rows, "regParam double, elasticNetParam double, accuracy double")


@query("ml7_boosted_trees")
def _(t):
    matrix, train, test, target = _design(t, "language")
    model = ml.boosted_trees(rounds=5, depth=3).fit(ml.training_rows(matrix, train))
    return ml.score(model, matrix, test, ["doc_id"], target)


@query("ml8_balanced_weights", """
    select o_orderpriority, count(*) as n, (sum(count(*)) over ()) / (count(*) over () * count(*)) as weight from orders group by 1""")
def _(t):
    return mt.balanced_weights(t.orders, "o_orderpriority")


@query("ml9_smote_counts", """
    with c as (select label, count(*) as n from embeddings group by 1)
    select label, case when label in (0, 1) then greatest(n, (select max(n) from c) + 20) else n end as n from c""")
def _(t):
    return _oversampled(t).groupBy("label").agg(F.count("*").alias("n"))


def _oversampled(t):
    v = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    target = v.groupBy("label").count().agg(F.max("count")).first()[0] + 20
    return ml.smote(v, "label", "vec_id", "embedding", {0: target, 1: target}, k=5, seed=11)


_DRAWN = "('0x' || substr(md5('11|{what}|' || draw), 1, 8))::bigint"


@query("ml9_smote", f"""
    with m as (select vec_id, label, cast(embedding as double[]) as x, row_number() over (partition by label order by md5('11|' || vec_id), vec_id) - 1 as pos
        from embeddings),
    have as (select label, count(*) as n from embeddings group by 1), top as (select max(n) + 20 as target from have),
    draws as (select label, draw, {_DRAWN.format(what="row")} % n as pos, {_DRAWN.format(what="neighbour")} % least(5, n - 1) as pick,
        {_DRAWN.format(what="gap")} / 4294967296.0 as gap
        from (select label, n, unnest(range(target - n)) as draw from have, top where label in (0, 1) and n > 1)),
    seeds as (select distinct label, pos from draws),
    near as (select a.label, a.pos, b.pos as other,
            row_number() over (partition by a.label, a.pos order by list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.pos) - 1 as rank
        from m a join seeds using (label, pos) join m b on a.label = b.label and a.pos <> b.pos),
    mixed as (select d.label, list_transform(list_zip(a.x, b.x), lambda z: z[1] + gap * (z[2] - z[1])) as v
        from draws d join near n on d.label = n.label and d.pos = n.pos and pick = rank
        join m a on a.label = d.label and a.pos = d.pos join m b on b.label = d.label and b.pos = other)
    select label, round(v[1], 9) as first, round(v[len(v)], 9) as last, round(list_sum(v), 6) as total from mixed""")
def _(t):
    new = _oversampled(t).where("vec_id is null")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return new.select("label", F.round(F.element_at("embedding", 1), 9).alias("first"), F.round(F.element_at("embedding", -1), 9).alias("last"),
                      F.round(total, 6).alias("total"))


@query("ml10_score_and_check")
def _(t):
    model, matrix, _train, test, target = _fitted_logistic(t)
    scored = ml.score(model, matrix, test, ["doc_id"], target)
    return scored.agg(F.count("*").alias("n"), F.avg(F.when(mt.correct(), 1.0).otherwise(0.0)).alias("accuracy"))


# ---------------------------------------------------------------- metrics

_SQL_CLASSES = f"""{SQL_PREDICTIONS}, sides as (
    select model, truth as label, 1 as actual, 0 as predicted, cast(truth = prediction as integer) as hit from predictions
    union all select model, prediction, 0, 1, 0 from predictions),
    counts as (select model, label, sum(hit) as tp, sum(predicted) as predicted, sum(actual) as support from sides group by 1, 2),
    report as (select model, label, coalesce(tp / nullif(predicted, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall,
        coalesce(2 * tp / nullif(predicted + support, 0), 0) as f1, support, tp from counts)"""


@query("ml11_accuracy_summary", f"""
    with {_SQL_CLASSES} select model, cast(sum(support) as bigint) as n, round(sum(tp) / sum(support), 6) as accuracy,
        round(sum(f1 * support) / sum(support), 6) as weighted_f1, round(max(support) / sum(support), 6) as majority_share from report group by 1""")
def _(t):
    s = mt.summary(predictions(t), ["model"])
    return s.withColumns({c: F.round(c, 6) for c in ("accuracy", "weighted_f1", "majority_share")})


_CODE = "case {c} when 'URGENT' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 end"
_NEAR = f"coalesce(abs({_CODE.format(c='truth')} - {_CODE.format(c='prediction')}) <= 1, false)"


@query("ml12_ordinal_shares", f"""
    with {SQL_PREDICTIONS} select model, round(avg(case when truth = prediction then 1.0 else 0.0 end), 6) as exact,
        round(avg(case when {_NEAR} then 1.0 else 0.0 end), 6) as within_1 from predictions group by 1""")
def _(t):
    s = mt.ordinal_shares(predictions(t), GRADE_RANK, by=["model"])
    return s.withColumns({c: F.round(c, 6) for c in ("exact", "within_1")})


@query("ml13_class_report", f"""
    with {_SQL_CLASSES} select model, label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from report""")
def _(t):
    r = mt.class_report(predictions(t), ["model"])
    return r.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("ml13_weighted_average", f"""
    with {_SQL_CLASSES} select model, round(sum(precision * support) / sum(support), 6) as precision, round(sum(recall * support) / sum(support), 6) as recall,
        round(sum(f1 * support) / sum(support), 6) as f1, cast(sum(support) as bigint) as support from report group by 1""")
def _(t):
    r = mt.weighted_average(mt.class_report(predictions(t), ["model"]), ["model"])
    return r.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("ml14_confusion", f"""
    with {SQL_PREDICTIONS}, p as (select * from predictions), m as (select distinct model from p),
    c as (select truth as c from p union select prediction from p)
    select m.model, c.c as truth, {", ".join(f'''count(*) filter (where prediction = '{c}') as "{c}"''' for c in _CLASSES)}
    from m cross join c left join p on p.model = m.model and p.truth = c.c group by 1, 2""")
def _(t):
    return mt.confusion(predictions(t), by=["model"])


def _shared_model(t):
    model, matrix, train, test, target = _fitted_logistic(t)

    def predict(rows):
        scored = model.transform(matrix.transform(rows))
        return scored.withColumn("prediction", F.col("prediction").cast("int").cast("string")).withColumn("truth", F.col("label").cast("int").cast("string"))

    return predict, test


@query("ml15_permutation_importance")
def _(t):
    predict, test = _shared_model(t)
    features = ["word_count", "n_sentences", "num_transparency", "mean_sentence_length", "capital_run"]
    return ml.permutation_importance(test, ["doc_id"], features, predict, repeats=3)


@query("ml16_importance_ranks", """
    with raw as (select concat(case when p_size % 2 = 0 then 'num__' else 'cat__' end, p_brand) as raw, round(avg(p_retailprice), 3) as importance from part group by 1),
    named as (select regexp_replace(raw, '^(num__|cat__)', '') as feature, substr(raw, 1, 3) as kind, importance from raw)
    select feature, importance, cast(floor(rank() over (order by importance desc) + (count(*) over (partition by importance) - 1) / 2.0) as bigint) as rank from named where kind = 'num'""")
def _(t):
    kind = F.when(F.col("p_size") % 2 == 0, "num__").otherwise("cat__")
    raw = t.part.groupBy(F.concat(kind, "p_brand").alias("raw")).agg(F.round(F.avg("p_retailprice"), 3).alias("importance"))
    named = raw.select(F.regexp_replace("raw", "^(num__|cat__)", "").alias("feature"), F.substring("raw", 1, 3).alias("kind"), "importance")
    return average_rank(named.where("kind = 'num'").drop("kind"), [], "importance").select("feature", "importance", "rank")


@query("ml17_tree_importance")
def _(t):
    matrix, train, _test, _target = _design(t)
    ready = ml.training_rows(matrix, train)
    model = ml.forest(trees=10, depth=4).fit(ready)
    return ml.importance_table(t.spark, model.featureImportances, ml.feature_names(ready), 15)


@query("ml18_coefficients")
def _(t):
    model, matrix, train, _test, _target = _fitted_logistic(t)
    return ml.coefficient_table(t.spark, model, ml.class_labels(matrix), ml.feature_names(matrix.transform(train)))


@query("ml19_prior_baseline", f"""
    with s as (select o_orderkey, o_orderpriority as truth, case when {_UNIFORM.format(seed=3, key="o_orderkey")} < 0.8 then 'train' else 'test' end as split,
        {_UNIFORM.format(seed=222, key="o_orderkey")} as u from orders),
    c as (select truth as label, sum(count(*)) over (order by truth) / sum(count(*)) over () as upper from s where split = 'train' group by truth)
    select o_orderkey, truth, arg_min(label, upper) as prediction from s join c on upper > u where split = 'test' group by 1, 2""")
def _(t):
    s = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("truth"), ml.split_flag(["o_orderkey"], 0.8, 3).alias("split"))
    out = ml.prior_baseline(s.where("split = 'train'"), s.where("split = 'test'"), "truth", ["o_orderkey"], seed=222)
    return out.select("o_orderkey", "truth", "prediction")


_PAIRS = (("size", "customer"), ("size", "constant"), ("customer", "constant"))
_SQL_PAIRS = SQL_PREDICTIONS + ", pairs as (\n    " + "\n    union all ".join(
    f"""select '{a}' as model_1, '{b}' as model_2, x.truth = x.prediction as one, y.truth = y.prediction as two
    from predictions x join predictions y on x.o_orderkey = y.o_orderkey where x.model = '{a}' and y.model = '{b}'""" for a, b in _PAIRS
) + """), cells as (select model_1, model_2, count(*) filter (where one and two) as both_right, count(*) filter (where one and not two) as only_1_right,
    count(*) filter (where two and not one) as only_2_right, count(*) filter (where not one and not two) as both_wrong from pairs group by 1, 2)"""
_CHI = """select *, round((only_1_right - only_2_right) ** 2 / nullif(only_1_right + only_2_right, 0), 6) as chi2,
    round((abs(only_1_right - only_2_right) - 1) ** 2 / nullif(only_1_right + only_2_right, 0), 6) as chi2_corrected from cells"""


@query("ml20_mcnemar_table", f"with {_SQL_PAIRS} {_CHI}")
def _(t):
    pairs = mt.model_pairs(predictions(t), ["o_orderkey"], _PAIRS)
    table = mt.agreement_table(pairs, ["model_1", "model_2"])
    return table.withColumns({c: F.round(c, 6) for c in ("chi2", "chi2_corrected")})


# erfc by its series below 3, by its continued fraction above; the binomial tail by its terms.
_ERFC = """case when z < 3 then 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda i: (-1) ** i * z ** (2 * i + 1) / (gamma(i + 1) * (2 * i + 1))))
    else exp(-z * z) / sqrt(pi()) / list_reduce(list_prepend(z, list_transform(range(60, 0, -1), lambda i: i / 2.0)), lambda a, x: z + x / a) end"""


def _sql_p_values(cells: str) -> str:
    """p-values of a table with only_1_right and only_2_right."""
    return f"""zs as (select *, only_1_right + only_2_right as n, least(only_1_right, only_2_right) as low,
        abs(only_1_right - only_2_right) / sqrt(nullif(2.0 * (only_1_right + only_2_right), 0)) as z1,
        abs(abs(only_1_right - only_2_right) - 1) / sqrt(nullif(2.0 * (only_1_right + only_2_right), 0)) as z2 from {cells}),
    ps as (select *, {_ERFC.replace("z", "z1")} as p_plain, {_ERFC.replace("z", "z2")} as p_corrected,
        case when n > 0 then least(1.0, 2 * list_sum(list_transform(range(0, low + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) - n * ln(2))))) end as p_exact from zs)"""


@query("ml20_mcnemar_p_values", f"""
    with {_SQL_PAIRS}, {_sql_p_values("cells")}
    select model_1, model_2, both_right, only_1_right, only_2_right, both_wrong, round(p_plain, 8) as p_plain, round(p_corrected, 8) as p_corrected, round(p_exact, 8) as p_exact from ps""")
def _(t):
    found = mt.mcnemar(mt.model_pairs(predictions(t), ["o_orderkey"], _PAIRS), ["model_1", "model_2"]).drop("chi2", "chi2_corrected")
    return found.withColumns({c: F.round(c, 8) for c in ("p_plain", "p_corrected", "p_exact")})


# A fourth model that never differs from the third.
_SQL_FOUR = SQL_PREDICTIONS + """, four as (select model, o_orderkey, truth = prediction as hit from predictions
    union all select 'same', o_orderkey, truth = prediction from predictions where model = 'constant'),
    cells as (select x.model as model_1, y.model as model_2, count(*) filter (where x.hit and y.hit) as both_right, count(*) filter (where x.hit and not y.hit) as only_1_right,
        count(*) filter (where y.hit and not x.hit) as only_2_right, count(*) filter (where not x.hit and not y.hit) as both_wrong
        from four x join four y on x.o_orderkey = y.o_orderkey and x.model < y.model group by 1, 2)"""


@query("ml21_p_value_block", f"""
    with {_SQL_FOUR}, {_sql_p_values("cells")}
    select model_1, model_2, both_right, only_1_right, only_2_right, both_wrong, {", ".join(f"coalesce(format('{{:.4f}}', {c}), '-') as {c}" for c in ("p_plain", "p_corrected", "p_exact"))} from ps""")
def _(t):
    p = predictions(t)
    p = p.unionByName(p.where("model = 'constant'").withColumn("model", F.lit("same")))
    table = mt.agreement_of_all(p, ["o_orderkey"], ["size", "customer", "constant", "same"])
    return mt.p_value_block(table)


_SQL_DRAWN = f"""drawn as (select o_orderkey, substr(truth, 3) as truth, substr(arg_min(label, upper), 3) as prediction from (
        select o_orderkey, o_orderpriority as truth, {_UNIFORM.format(seed=222, key="o_orderkey")} as u from orders where {_UNIFORM.format(seed=3, key="o_orderkey")} >= 0.8)
    join (select o_orderpriority as label, sum(count(*)) over (order by o_orderpriority) / sum(count(*)) over () as upper from orders
        where {_UNIFORM.format(seed=3, key="o_orderkey")} < 0.8 group by 1) on upper > u group by 1, 2)"""


@query("ml21_all_baselines", f"""
    with {_SQL_CLASSES}, {_SQL_DRAWN}, m as (select model, round(sum(tp) / sum(support), 6) as accuracy, max(support) / sum(support) as majority from report group by 1)
    select model, 'rule' as family, accuracy from m
    union all select 'Most Common Class Baseline', 'baseline', round(max(majority), 6) from m
    union all select 'Class Prior Baseline', 'baseline', round(avg(case when truth = prediction then 1.0 else 0.0 end), 6) from drawn""")
def _(t):
    s = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("truth"), ml.split_flag(["o_orderkey"], 0.8, 3).alias("split"))
    drawn = ml.prior_baseline(s.where("split = 'train'"), s.where("split = 'test'"), "truth", ["o_orderkey"], seed=222)
    table = mt.family_table({"rule": predictions(t)}, {"Class Prior Baseline": drawn})
    return table.withColumn("accuracy", F.round("accuracy", 6))


@query("ml21_model_comparison", f"""
    with {_SQL_CLASSES}, m as (select model, round(sum(tp) / sum(support), 6) as accuracy, round(sum(f1 * support) / sum(support), 6) as weighted_f1,
        max(support) / sum(support) as majority from report group by 1),
    w as (select model, round(avg(case when {_NEAR} then 1.0 else 0.0 end), 6) as within_1 from predictions group by 1)
    select m.model, accuracy, weighted_f1, within_1 from m join w on m.model = w.model
    union all select 'Most Common Class Baseline', round(max(majority), 6), null, null from m""")
def _(t):
    c = mt.comparison(predictions(t), GRADE_RANK)
    return c.withColumns({x: F.round(x, 6) for x in ("accuracy", "weighted_f1", "within_1")})


def _board(t):
    matrix, train, test, _target = _design(t)
    models = {
        "logistic": (ml.elastic_net(train.count(), c=1.0, max_iter=20), {"c": 1.0, "max_iter": 20}),
        "forest": (ml.forest(trees=10, depth=4), {"trees": 10, "depth": 4}),
    }
    ready = stored(ml.training_rows(matrix, train).select("features", "label"), "board")
    return ml.leaderboard(t.spark, models, ready, matrix.transform(test))


@query("ml22_leaderboard")
def _(t):
    return _board(t)[0]


@query("ml22_hyper_parameters")
def _(t):
    return _board(t)[1]


@query("ml23_restricted_population", f"""
    with {SQL_PREDICTIONS}, p as (select * from predictions where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING'))
    select model, count(*) as n, round(avg(case when truth = prediction then 1.0 else 0.0 end), 6) as accuracy from p group by model""")
def _(t):
    some = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    p = mt.restricted(predictions(t), some, ["o_custkey"])
    return p.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(F.when(mt.correct(), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query("ml23_retrained")
def _(t):
    """The rows of short documents: predictions of the model of all rows, and of one fitted to such rows with the same settings."""
    model, matrix, train, test, target = _fitted_logistic(t, saved=True)
    short = train.unionByName(test).where("word_count <= 500").select("doc_id")
    some, others = (r.join(short, "doc_id", "left_semi") for r in (train, test))
    filtered = mt.restricted(ml.score(model, matrix, test, ["doc_id"], target), short, ["doc_id"])
    own = mt.with_balanced_weight(some, target)
    settings = {"c": 1.0, "l1_ratio": 0.5, "weight": "weight"}
    again = ml.fitted(ml.elastic_net(some.count(), **settings), ml.training_rows(matrix, own), scratch(t, "models"), settings, key=own)
    both = filtered.select(F.lit("filtered").alias("branch"), "*").unionByName(
        ml.score(again, matrix, others, ["doc_id"], target).select(F.lit("retrained").alias("branch"), "*"))
    return both.groupBy("branch").agg(F.count("*").alias("n"), F.avg(F.when(mt.correct(), 1.0).otherwise(0.0)).alias("accuracy"))


@query("ml24_explained_variance")
def _(t):
    shares = mo.explained_variance(t.embeddings, "embedding", 5)
    return t.spark.createDataFrame([(i, s) for i, s in enumerate(shares, 1)], "component int, share double")


# The eigenvalues of a symmetric 3 x 3 matrix in closed form.
@query("ml24_three_columns", """
    with v as (select l_quantity / 50.0 as a, l_extendedprice / 100000.0 as b, l_discount * 10.0 as c from lineitem),
    m as (select covar_samp(a, a) as aa, covar_samp(b, b) as bb, covar_samp(c, c) as cc, covar_samp(a, b) as ab, covar_samp(a, c) as ac, covar_samp(b, c) as bc from v),
    q as (select *, (aa + bb + cc) / 3 as q, sqrt(((aa - (aa + bb + cc) / 3) ** 2 + (bb - (aa + bb + cc) / 3) ** 2 + (cc - (aa + bb + cc) / 3) ** 2 + 2 * (ab ** 2 + ac ** 2 + bc ** 2)) / 6) as p from m),
    r as (select *, acos(greatest(-1.0, least(1.0, (((aa - q) * ((bb - q) * (cc - q) - bc ** 2) - ab * (ab * (cc - q) - bc * ac) + ac * (ab * bc - (bb - q) * ac)) / p ** 3) / 2))) / 3 as phi from q),
    e as (select q + 2 * p * cos(phi) as e1, q + 2 * p * cos(phi + 2 * pi() / 3) as e3, 3 * q as total from r)
    select component::int as component, round(case component when 1 then e1 when 2 then total - e1 - e3 else e3 end / total, 8) as share from e, (values (1), (2), (3)) x(component)""")
def _(t):
    v = t.lineitem.select(F.array(F.col("l_quantity") / 50.0, F.col("l_extendedprice") / 100000.0, F.col("l_discount") * 10.0).alias("v"))
    shares = mo.explained_variance(v, "v", 3)
    return t.spark.createDataFrame([(i, round(s, 8)) for i, s in enumerate(shares, 1)], "component int, share double")
