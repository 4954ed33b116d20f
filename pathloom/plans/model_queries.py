"""Cross-validated models on orders (regression) and documents (classification)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import folds as Fo
from pathloom.operators import inference as I
from pathloom.operators import metrics as Me
from pathloom.operators import models as Mo
from pathloom.operators.cohort import importance_shares
from pathloom.plans import cohort_queries as cq
from pathloom.plans import fixture as fx
from pathloom.plans.registry import query
from pathloom.session import materialize

FEATS = ["price", "n_lines", "discount", "late"]
DOC_FEATS = ["n_chars", "lines", "e_share", "is_en"]


def order_features(spark, sf):
    """One row per order: outcome, customer as group, four columns, one with gaps."""
    li = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("y"), F.count(F.lit(1)).alias("n_lines"),
        F.avg("l_discount").alias("discount"), F.max("l_shipdate").alias("last"))
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("grp"), "y",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 1000.0).alias("price"),
        F.col("n_lines").cast("double").alias("n_lines"), (F.col("discount") * 100).alias("discount"),
        F.datediff("last", "o_orderdate").cast("double").alias("late"))


def assignment(df, repeats=5):
    sizes = materialize(df.groupBy("grp").agg(F.count(F.lit(1)).alias("size")))
    outer = Fo.grouped_folds(sizes, "grp", repeats, 5, "outer")
    return materialize(Mo.hashed_inner_folds(outer, "grp", 5, 5, "inner"))


def outer_assignment(df, repeats=5):
    """The same outer folds for fits that have no inner ones."""
    sizes = materialize(df.groupBy("grp").agg(F.count(F.lit(1)).alias("size")))
    return Mo.outer_sets(materialize(Fo.grouped_folds(sizes, "grp", repeats, 5, "outer")), "grp", 5)


@query("elasticnet_cv")
def elasticnet_cv(spark, sf):
    df = materialize(order_features(spark, sf))
    f = Mo.elastic_net_cv(df, assignment(df), "grp", FEATS, "y")
    return f.select("repeat", "outer_fold", "alpha", "l1_ratio", "n_train", "n_test",
                    F.round("inner_rmse", 6).alias("inner_rmse"), F.round("test_sse", 3).alias("test_sse"))


@query("elasticnet_oof_metrics")
def elasticnet_oof_metrics(spark, sf):
    df = materialize(order_features(spark, sf))
    a = assignment(df)
    fits = materialize(Mo.elastic_net_cv(df, a, "grp", FEATS, "y"))
    oof = Mo.predict_oof(df, a, fits, "sample_id", "grp", FEATS, "y")
    b = Me.metric_block(oof, ["repeat"])
    return b.select("repeat", "n", *[F.round(c, 6).alias(c) for c in ("r2", "rmse", "mae", "pearson")])


@query("fixed_hp_refit")
def fixed_hp_refit(spark, sf):
    df = materialize(order_features(spark, sf))
    a = outer_assignment(df)
    chosen = a.select("repeat", "outer_fold").distinct().select(
        "repeat", "outer_fold", F.lit(0.01).alias("alpha"), F.lit(0.5).alias("l1_ratio"))
    fits = materialize(Mo.fixed_fits(df, a, chosen, "grp", FEATS, "y"))
    oof = Mo.predict_oof(df, a, fits, "sample_id", "grp", FEATS, "y")
    return Me.metric_block(oof, ["repeat"]).select("repeat", "n", F.round("r2", 6).alias("r2"))


@query("train_medians", """
with recursive """ + """g as (
  select o_custkey grp, count(*)::bigint size from (select distinct l_orderkey from lineitem)
  join orders on o_orderkey = l_orderkey group by 1),
o as (select r::int repeat, grp, size, row_number() over (partition by r
        order by size desc, sha256('outer|' || r || '|' || grp), grp) i from g, range(5) t(r)),
st as (
  select repeat, 1 i, 0 fold, grp, [size, 0, 0, 0, 0]::bigint[] loads from o where i = 1
  union all
  select repeat, i + 1, p - 1, grp, list_transform(loads, lambda x, k: x + case when k = p
         then size else 0 end)
  from (select s.repeat, s.i, o.grp, o.size, s.loads, list_position(s.loads, list_min(s.loads)) p
        from st s join o on o.repeat = s.repeat and o.i = s.i + 1)),
x as (select o_custkey grp, o_totalprice / 1000.0 price from orders
      where o_orderstatus <> 'P' and o_orderkey in (select l_orderkey from lineitem))
select repeat, f::int outer_fold, count(*)::bigint n, round(quantile_cont(price, 0.5), 6) median_price
from x join st using (grp), range(5) t(f) where fold <> f group by repeat, f""")
def train_medians(spark, sf):
    df = materialize(order_features(spark, sf).select("grp", "price"))
    a = assignment(df)
    m = Mo.fold_medians(df, a, "grp", ["price"], False)
    n = df.where("price is not null").join(a.where("inner >= 0"), "grp").groupBy("repeat", "outer_fold").agg(
        F.count(F.lit(1)).alias("n"))
    return m.join(n, ["repeat", "outer_fold"]).select("repeat", "outer_fold", "n", F.round("price", 6).alias("median_price"))


# ---- documents -----------------------------------------------------------------------------------

DOC_SQL = """with d as (
  select doc_id, quality, n_chars::double n_chars,
    (len(text) - len(replace(text, chr(10), '')))::double lines,
    (len(text) - len(replace(text, 'e', '')))::double / greatest(len(text), 1) e_share,
    (lang = 'en')::int::double is_en
  from documents join labels using (doc_id)),
f as (select doc_id, r::int repeat, ((row_number() over (partition by r, quality
   order by sha256('strat|' || r || '|' || doc_id), doc_id) - 1) % 5)::int fold from labels, range(5) t(r)
   where doc_id in (select doc_id from documents))"""


def doc_features(spark, sf):
    n = F.length("text")
    less = lambda s: (n - F.length(F.replace("text", F.lit(s), F.lit("")))).cast("double")
    d = fx.table(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), less("\n").alias("lines"),
        (less("e") / F.greatest(n, F.lit(1))).alias("e_share"),
        (F.col("lang") == "en").cast("double").alias("is_en"))
    return d.join(fx.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


def doc_folds(df, repeats=5):
    return Fo.stratified_folds(df, "quality", "doc_id", 5, repeats).select("doc_id", "repeat", "fold")


@query("train_only_scaling", DOC_SQL + """
select repeat, t.f::int fold, count(*)::bigint n_train, """ + ", ".join(
    f"round(avg({c}), 6) mean_{c}, round(stddev_pop({c}), 6) sd_{c}" for c in DOC_FEATS) + """
from d join f using (doc_id), range(5) t(f) where f.fold <> t.f group by repeat, t.f""")
def train_only_scaling(spark, sf):
    df = materialize(doc_features(spark, sf))
    s = Mo.train_scaling(df, doc_folds(df), "doc_id", DOC_FEATS, 5)
    return s.select("repeat", "fold", "n_train", *[
        F.round(f"{k}_{c}", 6).alias(f"{k}_{c}") for c in DOC_FEATS for k in ("mean", "sd")])


@query("logistic_cv")
def logistic_cv(spark, sf):
    df = materialize(doc_features(spark, sf))
    folds = materialize(doc_folds(df))
    fits = Mo.logistic_cv(df, folds, "doc_id", "quality", DOC_FEATS)
    p = Mo.predict_logistic(df, folds, fits, "doc_id", "quality", DOC_FEATS)
    a = I.auc(p.withColumn("score", F.round("score", 9)), ["repeat"], "quality", "score")
    t = I.threshold_scores(p, ["repeat"], "quality", "score")
    return a.join(t, "repeat").select("repeat", "n_pos", "n_neg", *[
        F.round(c, 6).alias(c) for c in ("auc", "accuracy", "sensitivity", "specificity")])


@query("feature_importance")
def feature_importance(spark, sf):
    df = materialize(doc_features(spark, sf))
    imp = Mo.forest_importance(df, "quality", DOC_FEATS, trees=500)
    return importance_shares(imp, "feature", "importance").select(
        "feature", "grp", F.round("share", 6).alias("share"))


@query("per_length_models")
def per_length_models(spark, sf):
    s = cq.subpaths(spark, sf)
    f = Mo.per_length_fits(materialize(s), "length", "u", ["nav", "rout", "search", "comm"], "y")
    return f.select("length", "n", "alpha", "l1_ratio", F.round("oof_r2", 6).alias("oof_r2"),
                    F.transform("coef", lambda c: F.round(c, 6)).alias("coef"),
                    F.transform("median_coef", lambda c: F.round(c, 6)).alias("median_coef"))


# ---- end to end: cells of the path graph, endpoint block against path features and controls -------


def cell_arms(spark, sf):
    """(cells with outcome and every feature block, columns of every arm)."""
    from pathloom.operators import diversity as D
    from pathloom.operators import features as V
    from pathloom.operators import graph as G
    from pathloom.operators import nulls as N
    from pathloom.plans.feature_queries import CELL, _with_order, sampled

    e, d, p = sampled(spark, sf)
    p = materialize(p)
    edge = _with_order(p).select(*CELL, *[N.permute(m, "ord").alias(m) for m in fx.METRICS])
    order = N.order_shuffle(p.select("nodes", "path_key"), e.where("mask"), "path_key", "ord")
    order = G.gather(p.select(*CELL, "path_key").join(
        order.select("path_key", F.col("shuffled").alias("nodes")), "path_key"), e,
        [*CELL, "path_key"], list(fx.METRICS))
    chosen = D.diverse_paths(p, CELL)
    picked = G.gather(chosen, e, CELL, list(fx.METRICS))
    arms = {"C8R": p, "C8R_selected": picked, "control_order": order, "control_edge": edge}
    c4 = V.endpoint_block(p.select(*CELL).distinct(), e, fx.MAX_LEN)
    out = e.select(F.col("u").alias("seed"), F.col("v").alias("endpoint"), "y").join(
        c4, ["seed", "endpoint"])
    base = [c for c in c4.columns if c not in CELL]
    cols = {"C4": base}
    for name, paths in arms.items():
        block = V.legendre_features(paths, CELL, fx.MAX_LEN)
        names = [c for c in block.columns if c not in CELL]
        out = out.join(block.select(*CELL, *[F.col(c).alias(f"{name}_{c}") for c in names]), CELL, "left")
        cols[name] = base + [f"{name}_{c}" for c in names]
    return materialize(out.withColumn("sample_id", F.concat_ws("|", *CELL))), cols


@query("control_sweep")
def control_sweep(spark, sf):
    """R2 of the endpoint arm, the path arms and the controls, and whether a control
    replicates the real arm's gain."""
    df, cols = cell_arms(spark, sf)
    sizes = materialize(df.groupBy("seed").agg(F.count(F.lit(1)).alias("size")))
    outer = Fo.grouped_folds(sizes, "seed", 5, 5, "cells")
    assign = materialize(Mo.hashed_inner_folds(outer, "seed", 5, 5, "cells-inner"))
    oof = None
    for arm, names in cols.items():
        fits = Mo.elastic_net_cv(df, assign, "seed", names, "y")
        part = Mo.predict_oof(df, assign, fits, "sample_id", "seed", names, "y").withColumn(
            "arm", F.lit(arm))
        oof = part if oof is None else oof.unionByName(part)
    r = materialize(Me.repeat_r2(materialize(oof), ["arm"]))
    base = {x["arm"]: x["r2"] for x in r.collect()}  # one row per arm
    gain = F.col("r2") - F.lit(base["C4"])
    real = base["C8R"] - base["C4"]
    return r.select("arm", F.round("r2", 6).alias("r2"), F.round(gain, 6).alias("gain"),
                    (F.col("arm").startswith("control") & (gain >= F.lit(real))).alias("replicates_real"))
