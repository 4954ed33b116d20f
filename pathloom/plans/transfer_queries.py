"""Transfer between document languages, and intervals from resampled counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import inference as I
from pathloom.operators import resampling as Rs
from pathloom.operators import transfer as T
from pathloom.plans import model_queries as mq
from pathloom.plans.inference_queries import SCORE_SQL, auc_sql, scores
from pathloom.plans.registry import query
from pathloom.session import materialize

REPEATS = 5        # fixed value
DRAWS = 1000       # fixed value: draws of an interval
FEATS = ["n_chars", "lines", "e_share"]
MODELS = {"M1": FEATS[:1], "M2": FEATS[:2], "M3": FEATS}


def halves(spark, sf):
    """Labelled documents with their columns; the domain is English or not."""
    return mq.doc_features(spark, sf).withColumn("domain", F.when(F.col("is_en") == 1, "en").otherwise("rest"))


def fitted(spark, sf):
    df = materialize(halves(spark, sf))
    roles = materialize(T.transfer_roles(df, "doc_id", "domain", ("en", "rest"), REPEATS, "transfer"))
    fits, scored = T.transfer_fits(df, roles, "doc_id", "quality", FEATS, MODELS)
    return df, fits, materialize(scored)


ROLE_SQL = f"""with d as (select doc_id, quality, case when lang = 'en' then 'en' else 'rest' end "domain"
  from documents join labels using (doc_id)),
o as (select d.*, r::int repeat, row_number() over (partition by r, "domain" order by sha256('transfer|' || r || '|' || doc_id), doc_id) i,
        count(*) over (partition by r, "domain") n from d, range({REPEATS}) t(r)),
v as (select unnest(['OOS', 'LETTER']) variant), s as (select unnest(['en', 'rest']) src),
ro as (select doc_id, quality, "domain", case when src = 'en' then 'en_to_rest' else 'rest_to_en' end direction, variant, repeat,
  case when i <= case when "domain" <> src then n // 2 when variant = 'LETTER' then n else round_even(0.8 * n, 0)::bigint end
       then 'train_' else 'test_' end || case when "domain" = src then 'source' else 'target' end as role from o, v, s)"""


@query("transfer_roles", ROLE_SQL + """
select doc_id, "domain", direction, variant, repeat, role from ro""")
def transfer_roles(spark, sf):
    return T.transfer_roles(halves(spark, sf), "doc_id", "domain", ("en", "rest"), REPEATS, "transfer")


@query("lodo_optimality", ROLE_SQL + """
select direction, variant, repeat, model, count(*)::bigint n_train, sum(quality)::bigint n_pos, true converged, true optimal
from ro, (select unnest(['M1', 'M2', 'M3']) model) where role like 'train%' group by all""")
def lodo_optimality(spark, sf):
    """Every transfer fit with the size of its training set; the gradient recomputed from the rows is zero."""
    df, fits, scored = fitted(spark, sf)
    g = T.gradient_check(df, scored, fits, "doc_id", FEATS, MODELS)
    return g.select("direction", "variant", "repeat", "model", "n_train", "n_pos", "converged",
                    (F.col("gradient") < 1e-6 * F.col("n_train")).alias("optimal"))


def summary(spark, sf, variant):
    """Mean and spread of the AUC over repeats, threshold scores, and the interval of the AUC of
    the mean scores of the pooled rows."""
    _, _, scored = fitted(spark, sf)
    judged = T.pooled_roles(scored.where(F.col("variant") == variant)).withColumn("score", F.round("score", 9))
    keys = ["direction", "model"]
    each = I.auc(judged, [*keys, "repeat"], "label", "score").join(
        I.threshold_scores(judged, [*keys, "repeat"], "label", "score"), [*keys, "repeat"])
    over = each.groupBy(*keys).agg(
        F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("sd_auc"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("accuracy", "sensitivity", "specificity")])
    mean = judged.groupBy(*keys, "doc_id").agg(F.first("label").alias("label"), F.round(F.avg("score"), 9).alias("score"))
    ci = Rs.intervals(Rs.auc_draws(mean, "label", "score", DRAWS, f"lodo|{variant}", keys), keys)
    n = mean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pooled"))
    return over.join(ci.select(*keys, "ci_low", "ci_high"), keys).join(n, keys).select(
        *keys, "n_pooled", *[F.round(c, 6).alias(c) for c in (
            "mean_auc", "sd_auc", "ci_low", "ci_high", "mean_accuracy", "mean_sensitivity", "mean_specificity")])


@query("lodo_oos")
def lodo_oos(spark, sf):
    return summary(spark, sf, "OOS")


@query("lodo_letter")
def lodo_letter(spark, sf):
    return summary(spark, sf, "LETTER")


@query("auc_interval")
def auc_interval(spark, sf):
    return Rs.intervals(Rs.auc_draws(long_scores(spark, sf), "quality", "score", DRAWS, "counts", ["model"]), ["model"])


def long_scores(spark, sf):
    return scores(spark, sf).select("quality", F.inline(F.array(
        F.struct(F.lit("s1").alias("model"), F.col("s1").alias("score")),
        F.struct(F.lit("s2").alias("model"), F.col("s2").alias("score")))))


@query("auc_interval_check", SCORE_SQL + ", a as (select 's1' model, * from (" + auc_sql("", "s1", "sc") + """)
  union all select 's2', * from (""" + auc_sql("", "s2", "sc") + f""")),
pl as (select 's1' model, quality, s1 s from sc union all select 's2', quality, s2 from sc),
v as (select model, quality, s, (select avg(case when y.s < x.s then 1.0 when y.s = x.s then 0.5 else 0 end) from pl y
        where y.model = x.model and y.quality <> x.quality) below from pl x),
de as (select model, sqrt(var_samp(below) filter (quality = 1) / count(*) filter (quality = 1)
        + var_samp(below) filter (quality = 0) / count(*) filter (quality = 0)) sd from v group by model)
select model, n_pos, n_neg, round(auc, 9)::double auc, round(sd, 9)::double delong_sd, {DRAWS}::bigint n_draws,
       true centred, true spread_fits from a join de using (model)""")
def auc_interval_check(spark, sf):
    """Draws from counts against the point estimate and the spread from the placements of all rows:
    the mean lies within four standard errors, the spread within 15 %."""
    s = materialize(long_scores(spark, sf))
    point = I.auc(s, ["model"], "quality", "score")
    iv = Rs.intervals(Rs.auc_draws(s, "quality", "score", DRAWS, "counts", ["model"]), ["model"])
    c = materialize(s.groupBy("model", "score").agg(F.sum("quality").alias("pos"), F.sum(1 - F.col("quality")).alias("neg")))
    from pathloom.operators.ordered import scan

    run = scan(c, ["model"], ["score"], {"up": ("sum", F.col("pos")), "un": ("sum", F.col("neg"))})
    n = point.select("model", "n_pos", "n_neg", "auc")
    v = run.join(n, "model").withColumn("vp", (F.col("un") - F.col("neg") / 2.0) / F.col("n_neg")).withColumn(
        "vn", (F.col("up") - F.col("pos") / 2.0) / F.col("n_pos"))
    var = lambda k, x, m: (F.sum(F.col(k) * (F.col(x) - m) * (F.col(x) - m)) / (F.first(f"n_{k}") - 1))
    sd = v.groupBy("model").agg(F.sqrt(var("pos", "vp", F.col("auc")) / F.first("n_pos")
                                       + var("neg", "vn", 1 - F.col("auc")) / F.first("n_neg")).alias("delong_sd"))
    j = n.join(iv, "model").join(sd, "model")
    return j.select("model", "n_pos", "n_neg", F.round("auc", 9).alias("auc"), F.round("delong_sd", 9).alias("delong_sd"), "n_draws",
                    (F.abs(F.col("mean") - F.col("auc")) <= 4 * F.col("delong_sd") / F.sqrt("n_draws") + 1e-9).alias("centred"),
                    (F.abs(F.col("sd") / F.col("delong_sd") - 1) < 0.15).alias("spread_fits"))
