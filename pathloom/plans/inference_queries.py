"""Folds, fit metrics and resampling inference.

A sample is an order, its outcome the ordered quantity, its cluster the
customer's nation.  The arms predict with whole-number errors, so sums of
squares are exact.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions.columns import hash_mod
from pathloom.operators import folds as Fo
from pathloom.operators import graph as G
from pathloom.operators import inference as I
from pathloom.operators import metrics as Me
from pathloom.operators import reshape as R
from pathloom.operators import validation as Va
from pathloom.operators.ordered import value_ranks
from pathloom.plans import fixture as fx
from pathloom.plans.feature_queries import FEAT_SQL, sample_sql, sampled
from pathloom.plans.registry import query
from pathloom.session import materialize

REPEATS, FOLDS = fx.REPEATS, fx.FOLDS
# fixed values: draws of the sign flips, the cluster and AUC bootstraps and the null sets
DRAWS_SIGN, DRAWS_BOOT, DRAWS_AUC, DRAWS_NULL = 100_000, 10_000, 1_000, 10_000
DRAWS_MEAN = 10_000  # of the mean-difference bootstrap
ARMS = ["C4", "C8R"]
ORDERS_A_TASK = 100_000  # ten rows each once repeats and arms are dealt out

OOF_SQL = """
smp as (
  select o_orderkey sample_id, c_nationkey seed, o_orderdate, sum(l_quantity)::double y_true
  from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
  group by all),
rep as (
  select s.*, r::int repeat, (('0x' || substr(sha256('fold|' || r || '|' || seed), 1, 13))::bigint
         % 5)::int outer_fold from smp s, range(5) t(r)),
wide as (
  select *, y_true + 4.0 * ((sample_id * 7 + repeat * 5) % 21 - 10) c8r_pred,
         y_true + 4.0 * ((sample_id * 11 + repeat * 3) % 25 - 12) c4_pred from rep),
oof as (
  select sample_id, seed, repeat, outer_fold, y_true, 'C4' arm, c4_pred y_pred from wide
  union all select sample_id, seed, repeat, outer_fold, y_true, 'C8R', c8r_pred from wide)"""
WITH_OOF = "with " + OOF_SQL


def samples(spark, sf):
    """One row per order, hash-partitioned by it: a task has some ``ORDERS_A_TASK`` orders, and
    later groups by sample find their rows together."""
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = fx.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("seed"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), o.count() // ORDERS_A_TASK)
    q = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity").repartition(tasks, "l_orderkey").groupBy(
        "l_orderkey").agg(F.sum("l_quantity").alias("y_true"))
    o = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "seed").repartition(tasks, "o_orderkey")
    return q.join(o, q.l_orderkey == o.o_orderkey).select(F.col("o_orderkey").alias("sample_id"), "seed", "y_true")


def wide(spark, sf, of=None):
    s = (samples(spark, sf) if of is None else of).withColumn(
        "repeat", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    k, r = F.col("sample_id"), F.col("repeat")
    return s.select(
        "sample_id", "seed", "repeat",
        hash_mod(FOLDS, "fold", r, F.col("seed")).cast("int").alias("outer_fold"), "y_true",
        (F.col("y_true") + 4.0 * ((k * 7 + r * 5) % 21 - 10)).alias("c8r_pred"),
        (F.col("y_true") + 4.0 * ((k * 11 + r * 3) % 25 - 12)).alias("c4_pred"))


def oof(spark, sf, of=None):
    w = wide(spark, sf, of)
    arm = F.explode(F.array(F.struct(F.lit("C4").alias("arm"), F.col("c4_pred").alias("y_pred")),
                            F.struct(F.lit("C8R").alias("arm"), F.col("c8r_pred").alias("y_pred"))))
    return w.select("sample_id", "seed", "repeat", "outer_fold", "y_true", arm.alias("e")).select(
        "sample_id", "seed", "repeat", "outer_fold", "y_true", "e.arm", "e.y_pred")


def paired(spark, sf):
    return wide(spark, sf).select("sample_id", "seed", "repeat", "outer_fold", "y_true",
                                  F.col("c8r_pred").alias("pa"), F.col("c4_pred").alias("pb"))


@query("sufficient_stats", WITH_OOF + """
select seed, arm, repeat, count(*)::bigint n, sum(y_true) sy, sum(y_true * y_true) syy,
       sum((y_true - y_pred) ** 2) sse from oof group by all""")
def sufficient_stats(spark, sf):
    return Me.sufficient_stats(oof(spark, sf), ["seed", "arm", "repeat"])


@query("metric_block", WITH_OOF + """
select arm, count(*)::bigint n,
  round(1 - sum((y_true-y_pred)**2) / (sum(y_true*y_true) - sum(y_true)*sum(y_true)/count(*)), 6) r2,
  round(sqrt(avg((y_true-y_pred)**2)), 6) rmse, round(avg(abs(y_true-y_pred)), 6) mae,
  round(corr(y_true, y_pred), 6) pearson, round(regr_slope(y_true, y_pred), 6) cal_slope,
  round(regr_intercept(y_true, y_pred), 4) cal_intercept from oof group by arm""")
def metric_block(spark, sf):
    b = Me.metric_block(oof(spark, sf), ["arm"])
    return b.select("arm", "n", *[F.round(c, 6).alias(c) for c in
                                  ("r2", "rmse", "mae", "pearson", "cal_slope")],
                    F.round("cal_intercept", 4).alias("cal_intercept"))


R2_SQL = """1 - sum((y_true-y_pred)**2) / (sum(y_true*y_true) - sum(y_true)*sum(y_true)/count(*))"""


@query("repeat_r2", WITH_OOF + f"""
select arm, round(avg(r2), 9) r2, count(*)::bigint n_repeats
from (select arm, repeat, {R2_SQL} r2 from oof group by all) group by arm""")
def repeat_r2(spark, sf):
    return Me.repeat_r2(oof(spark, sf), ["arm"]).withColumn("r2", F.round("r2", 9))


@query("sample_level_metrics", WITH_OOF + f"""
select arm, count(*)::bigint n, round({R2_SQL}, 9) r2, round(sqrt(avg((y_true-y_pred)**2)), 6) rmse
from (select arm, sample_id, min(y_true) y_true, avg(y_pred) y_pred from oof group by all)
group by arm""")
def sample_level_metrics(spark, sf):
    b = Me.sample_level(oof(spark, sf), ["arm"])
    return b.select("arm", "n", F.round("r2", 9).alias("r2"), F.round("rmse", 6).alias("rmse"))


@query("arm_contrast", WITH_OOF + f"""
, r as (select arm, repeat, {R2_SQL} r2 from oof group by all),
p as (select a.repeat, a.r2 ra, b.r2 rb from r a join r b on a.repeat = b.repeat
      where a.arm = 'C8R' and b.arm = 'C4')
select round(avg(ra), 9) r2_a, round(avg(rb), 9) r2_b, round(avg(ra - rb), 9) delta,
       count(*) filter (ra > rb)::bigint repeats_positive, count(*)::bigint n_repeats from p""")
def arm_contrast(spark, sf):
    r = Me.repeats_positive(oof(spark, sf), "C8R", "C4")
    return r.select(*[F.round(c, 9).alias(c) for c in ("r2_a", "r2_b", "delta")],
                    "repeats_positive", "n_repeats")


@query("metric_contrasts", WITH_OOF + f"""
, b as (select arm, {R2_SQL} r2, sqrt(avg((y_true-y_pred)**2)) rmse, avg(abs(y_true-y_pred)) mae
        from oof group by arm)
select x.arm a, y.arm b, round(x.r2-y.r2, 9) d_r2, round(x.rmse-y.rmse, 6) d_rmse,
       round(x.mae-y.mae, 6) d_mae from b x, b y where x.arm = 'C8R' and y.arm = 'C4'""")
def metric_contrasts(spark, sf):
    b = materialize(Me.metric_block(oof(spark, sf), ["arm"]))
    c = Me.contrasts(b, [("C8R", "C4")])
    return c.select("a", "b", F.round("d_r2", 9).alias("d_r2"), F.round("d_rmse", 6).alias("d_rmse"),
                    F.round("d_mae", 6).alias("d_mae"))


@query("oof_pivot", WITH_OOF + """
select sample_id, repeat, outer_fold, y_true, c4_pred, c8r_pred from wide""")
def oof_pivot(spark, sf):
    return R.oof_wide(oof(spark, sf), ARMS)


@query("oof_unpivot", WITH_OOF + """
select sample_id, repeat, outer_fold, y_true, arm, y_pred from oof""")
def oof_unpivot(spark, sf):
    return R.oof_long(wide(spark, sf).drop("seed"))


@query("pooled_arm", WITH_OOF + """
select sample_id, repeat, outer_fold, min(y_true) y_true, avg(y_pred) y_pred, 'pooled' arm
from oof group by sample_id, repeat, outer_fold""")
def pooled_arm(spark, sf):
    return R.pooled_arm(oof(spark, sf), ARMS, "pooled")


@query("repeat_medians", WITH_OOF + """
select sample_id, quantile_cont(c4_pred, 0.5) c4_pred, quantile_cont(c8r_pred, 0.5) c8r_pred
from wide group by sample_id""")
def repeat_medians(spark, sf):
    return Me.median_over_repeats(wide(spark, sf), ["sample_id"], ["c4_pred", "c8r_pred"])


@query("pair_validation", WITH_OOF + """,
n as (select count(*) c from wide),
folds as (select repeat, seed, count(distinct outer_fold) f from wide group by all)
select unnest(['arm A: empty_sample_id', 'arm A: null_value', 'arm A: nonfinite_value',
  'arm A: duplicate_key', 'arm A: several_predictions_per_repeat', 'unpaired_key',
  'outcome_differs', 'map_duplicate', 'map_empty', 'map_missing', 'incomplete_support',
  'outcome_changes', 'repeat_too_small', 'seed_in_several_folds']) as check,
  unnest([0, 0, 0,
   (select count(*) from (select 1 from wide group by sample_id, repeat, outer_fold having count(*) > 1)),
   (select count(*) from (select 1 from wide group by sample_id, repeat having count(*) > 1)),
   0, 0, (select count(*) from (select 1 from smp group by sample_id having count(*) > 1)),
   0, (select count(*) from wide where sample_id not in (select sample_id from smp)),
   (select count(*) from (select 1 from wide group by sample_id having count(*) <> 5)),
   (select count(*) from (select 1 from wide group by sample_id having min(y_true) <> max(y_true))),
   (select count(*) from (select 1 from wide group by repeat having count(*) < 3)),
   (select count(*) from folds where f > 1)]::bigint[]) n_bad""")
def pair_validation(spark, sf):
    w = materialize(wide(spark, sf))
    a, b = Va.wide_arms(w)
    smap = samples(spark, sf).select("sample_id", "seed")
    return Va.arm_checks(a, "arm A").unionByName(Va.pair_checks(a, b, smap))


@query("completion_checks", WITH_OOF + """
select arm, count(distinct (repeat, outer_fold))::bigint n_folds, 0::bigint n_missing,
  count(*)::bigint n_rows, count(distinct sample_id)::bigint n_samples,
  count(distinct (repeat, outer_fold)) = 25 and count(*) = count(distinct sample_id) * 5 complete
from oof group by arm""")
def completion_checks(spark, sf):
    return Va.completion_checks(oof(spark, sf), FOLDS, REPEATS)


# ---- folds ----------------------------------------------------------------------

FOLD_SQL = f"""with recursive g as (
  select o_custkey grp, count(*)::bigint size from orders group by 1),
o as (select r::int repeat, grp, size, row_number() over (partition by r
        order by size desc, sha256('fold|' || r || '|' || grp), grp) i from g, range({REPEATS}) t(r)),
st as (
  select repeat, 1 i, 0 fold, grp, [size, 0, 0, 0, 0]::bigint[] loads from o where i = 1
  union all
  select repeat, i + 1, p - 1, grp, list_transform(loads, lambda x, k: x + case when k = p
         then size else 0 end)
  from (select s.repeat, s.i, o.grp, o.size, s.loads, list_position(s.loads, list_min(s.loads)) p
        from st s join o on o.repeat = s.repeat and o.i = s.i + 1))"""


@query("fold_manifest", FOLD_SQL + """
select repeat, grp, fold::int test_fold from st""")
def fold_manifest(spark, sf):
    g = fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("grp")).agg(
        F.count(F.lit(1)).alias("size"))
    return Fo.grouped_folds(g, "grp", REPEATS, FOLDS)


@query("fold_sizes", FOLD_SQL + """
select repeat, fold::int test_fold, count(*)::bigint n_groups, sum(size)::bigint n_rows
from st join g using (grp) group by all""")
def fold_sizes(spark, sf):
    g = materialize(fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("grp")).agg(
        F.count(F.lit(1)).alias("size")))
    return Fo.grouped_folds(g, "grp", REPEATS, FOLDS).join(g, "grp").groupBy("repeat", "test_fold").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("size").alias("n_rows"))


@query("stratified_folds", """
select r::int repeat, doc_id, quality, ((row_number() over (partition by r, quality
   order by sha256('strat|' || r || '|' || doc_id), doc_id) - 1) % 5)::int fold
from labels, range(5) t(r)""")
def stratified_folds(spark, sf):
    return Fo.stratified_folds(fx.table(spark, sf, "labels"), "quality", "doc_id", FOLDS, REPEATS)


# ---- inference --------------------------------------------------------------------

UNIT_SQL = """,
sst as (select repeat, sum(y_true*y_true) - sum(y_true)*sum(y_true)/count(*) sst from wide group by 1),
eu as (select repeat, {unit} unit, sum((y_true-c4_pred)**2 - (y_true-c8r_pred)**2) e from wide group by all),
con as (select unit, sum(e / sst) / 5 d from eu join sst using (repeat) group by unit)"""

FLIP_SQL = """,
h as (select unit, d, blk, sha256('{tag}|' || unit || '|' || blk) h from con, range({blocks}) t(blk)),
bit as (select d, blk * 256 + (p - 1) * 4 + b draw,
   1 - 2 * ((('0x' || substr(h, p, 1))::int >> b) & 1) sign
   from h, range(1, 65) q(p), range(4) w(b)),
nul as (select draw, round(sum(sign * d), 12) nul from bit where draw < {draws} group by draw),
ob as (select sum(d) s, count(*)::bigint n from con),
t as (select count(*) filter (nul <= round(s, 12))::bigint lo,
             count(*) filter (nul >= round(s, 12))::bigint hi from nul, ob)
select n n_units, round(s, 9) observed, lo lower_tail, hi upper_tail,
  least(1.0, 2.0 * least(lo, hi) / {draws})::double p_two_sided,
  least(1.0, 2.0 * (least(lo, hi) + 1) / ({draws} + 1))::double p_two_sided_plus1 from t, ob"""


def _flip_sql(tag):
    return FLIP_SQL.format(tag=tag, draws=DRAWS_SIGN, blocks=(DRAWS_SIGN + 255) // 256)


@query("unit_contributions", WITH_OOF + UNIT_SQL.format(unit="seed") + """
select unit seed, round(d, 9) d from con""")
def unit_contributions(spark, sf):
    return I.unit_contributions(paired(spark, sf), "seed").withColumn("d", F.round("d", 9))


def _flip(df):
    return df.withColumn("observed", F.round("observed", 9))


@query("signflip_linked", WITH_OOF + UNIT_SQL.format(unit="seed") + _flip_sql("linked"))
def signflip_linked(spark, sf):
    c = materialize(I.unit_contributions(paired(spark, sf), "seed"))
    return _flip(I.signflip(c, "seed", DRAWS_SIGN, "linked"))


@query("signflip_within", WITH_OOF + UNIT_SQL.format(unit="(seed || '|' || repeat)")
       + _flip_sql("within"))
def signflip_within(spark, sf):
    c = materialize(I.within_repeat_contributions(paired(spark, sf), "seed"))
    return _flip(I.signflip(c, "unit", DRAWS_SIGN, "within"))


BOOT_SQL = """,
ss as (select seed, arm, repeat, count(*) n, sum(y_true) sy, sum(y_true*y_true) syy,
         sum((y_true-y_pred)**2) sse from oof group by all),
ix as (select seed, row_number() over (order by seed) - 1 idx from (select distinct seed from ss)),
nc as (select count(*) c from ix),
pk as (select draw, (('0x' || substr(sha256('boot|' || draw || '|' || slot.idx), 1, 13))::bigint
        % c) idx from ix slot, nc, range({draws}) t(draw)),
bs as (select draw, arm, repeat, sum(n) n, sum(sy) sy, sum(syy) syy, sum(sse) sse
       from pk join ix using (idx) join ss using (seed) group by all),
br as (select draw, arm, avg(1 - sse / (syy - sy * sy / n)) r2 from bs group by all),
dl as (select a.draw, a.r2 - b.r2 delta from br a join br b on a.draw = b.draw
       where a.arm = 'C8R' and b.arm = 'C4')""".replace("{draws}", str(DRAWS_BOOT))


@query("cluster_bootstrap_draws", WITH_OOF + BOOT_SQL + "select draw, arm, round(r2, 9) r2 from br")
def cluster_bootstrap_draws(spark, sf):
    return I.cluster_bootstrap(oof(spark, sf), "seed", DRAWS_BOOT, "boot").withColumn(
        "r2", F.round("r2", 9))


@query("cluster_bootstrap", WITH_OOF + BOOT_SQL + """
select count(*)::bigint n_effective, avg((delta > 0)::int)::double frac_positive,
  least(1.0, 2.0 * least(avg((delta <= 0)::int), avg((delta >= 0)::int)))::double p_raw,
  round(quantile_cont(delta, 0.025), 9) ci_low, round(quantile_cont(delta, 0.5), 9) median,
  round(quantile_cont(delta, 0.975), 9) ci_high from dl""")
def cluster_bootstrap(spark, sf):
    d = I.paired_delta(I.cluster_bootstrap(oof(spark, sf), "seed", DRAWS_BOOT, "boot"), "C8R", "C4")
    s = I.bootstrap_summary(materialize(d))
    return s.select("n_effective", "frac_positive", "p_raw",
                    *[F.round(c, 9).alias(c) for c in ("ci_low", "median", "ci_high")])


# p-values for the corrections: one per (type, brand) of parts, from integer scores
P_SQL = """with pv as (
  select p_type family, p_brand k, ((sum(p_size)::bigint * 7919) % 1000 + 1) / 1001.0::double p
  from part group by all),
r as (select *, row_number() over (partition by family order by p, k) i,
        count(*) over (partition by family) m from pv)"""


def p_values(spark, sf):
    return fx.table(spark, sf, "part").groupBy(
        F.col("p_type").alias("family"), F.col("p_brand").alias("k")).agg(
        ((F.sum("p_size") * 7919 % 1000 + 1) / F.lit(1001.0)).alias("p"))


@query("holm", P_SQL + """
select family, k, p, round(least(1.0, max(p * (m - i + 1)) over (partition by family order by i)), 9)
  p_holm from r""")
def holm(spark, sf):
    return I.holm(p_values(spark, sf), ["family"], "p", "k").withColumn(
        "p_holm", F.round("p_holm", 9))


@query("bh", P_SQL + """
select family, k, p, round(least(1.0, min(p * m / i) over (partition by family order by i desc)), 9)
  q_bh from r""")
def bh(spark, sf):
    return I.benjamini_hochberg(p_values(spark, sf), ["family"], "p", "k").withColumn(
        "q_bh", F.round("q_bh", 9))


@query("contrasts_by_length", WITH_OOF + f"""
, l as (select *, case when y_true < 50 then 1 when y_true < 100 then 2 else 3 end grp from oof),
ok as (select grp from l group by grp having count(distinct sample_id) >= 20
       and count(distinct seed) >= 10),
r as (select grp, arm, repeat, {R2_SQL} r2 from l join ok using (grp) group by all)
select a.grp, round(avg(a.r2 - b.r2), 6) delta, count(*)::bigint n_repeats
from r a join r b on a.grp = b.grp and a.repeat = b.repeat
where a.arm = 'C8R' and b.arm = 'C4' group by a.grp""")
def contrasts_by_length(spark, sf):
    y = F.col("y_true")
    length = F.when(y < 50, 1).when(y < 100, 2).otherwise(3).alias("grp")
    one = materialize(samples(spark, sf))  # repeats and arms repeat these rows
    many = lambda c, least: one.select(length, c).distinct().groupBy("grp").agg(
        F.count(c).alias("n")).where(F.col("n") >= least).select("grp")
    ok = many("sample_id", 20).join(many("seed", 10), "grp")
    o = oof(spark, sf, one).select("*", length)
    s = Me.sufficient_stats(o.join(F.broadcast(ok), "grp", "left_semi"), ["grp", "arm", "repeat"]).withColumn(
        "r2", Me.r2_from_sums(F.col("n"), F.col("sy"), F.col("syy"), F.col("sse")))
    per = s.groupBy("grp", "repeat").agg(
        (F.min(F.when(F.col("arm") == "C8R", F.col("r2")))
         - F.min(F.when(F.col("arm") == "C4", F.col("r2")))).alias("d"))
    return per.groupBy("grp").agg(F.round(F.avg("d"), 6).alias("delta"),
                                  F.count(F.lit(1)).alias("n_repeats"))


# ---- AUC: documents with labels; the score is the share of letters 'e' ---------------

SCORE_SQL = """with sc as (
  select d.doc_id, d.source, d.lang, l.quality, ((len(text) - len(replace(text, 'e', '')))::bigint * 1000
         // greatest(len(text), 1)) s1, (n_chars // 100) s2
  from documents d join labels l using (doc_id))"""


def scores(spark, sf):
    d = fx.table(spark, sf, "documents")
    n = F.length("text")
    e = n - F.length(F.replace("text", F.lit("e"), F.lit("")))
    d = d.select("doc_id", "source", "lang",
                 F.floor(e.cast("bigint") * 1000 / F.greatest(n, F.lit(1))).alias("s1"),
                 F.floor(F.col("n_chars") / 100).alias("s2"))
    return d.join(fx.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


def auc_sql(by: str, score: str, frm: str, weight: str = "1") -> str:
    g = f"{by}, " if by else ""
    part = f"partition by {by}" if by else ""
    return f"""select {g}(sum(pos * (up - n + (n + 1) / 2.0)) - sum(pos) * (sum(pos) + 1) / 2.0)
      / (sum(pos) * (sum(n) - sum(pos))) auc, sum(pos)::bigint n_pos, (sum(n) - sum(pos))::bigint n_neg
      from (select *, sum(n) over ({part} order by {score}) up from
        (select {g}{score}, sum({weight} * quality) pos, sum({weight}) n from {frm} group by {g}{score}))
      {'group by ' + by if by else ''}"""


@query("auc_by_group", SCORE_SQL + ", a as (" + auc_sql("lang", "s1", "sc") + """)
select lang, n_pos, n_neg, round(case when n_pos > 0 and n_neg > 0 then auc end, 9)::double auc from a""")
def auc_by_group(spark, sf):
    return I.auc(scores(spark, sf), ["lang"], "quality", "s1").withColumn("auc", F.round("auc", 9))


@query("threshold_scores", SCORE_SQL + """
select lang, avg(((s1 >= 90) = (quality = 1))::int)::double accuracy,
  count(*) filter (s1 >= 90 and quality = 1)::double / nullif(count(*) filter (quality = 1), 0) sensitivity,
  count(*) filter (s1 < 90 and quality = 0)::double / nullif(count(*) filter (quality = 0), 0) specificity
from sc group by lang""")
def threshold_scores(spark, sf):
    return I.threshold_scores(scores(spark, sf), ["lang"], "quality", "s1", 90)


AUCB_SQL = SCORE_SQL + f""",
ix as (select doc_id, quality, row_number() over (partition by quality order by doc_id) - 1 idx,
         count(*) over (partition by quality) n from sc),
pk as (select draw, quality, (('0x' || substr(sha256('aucb|' || draw || '|' || quality || '|' || idx),
        1, 13))::bigint % n) idx from ix, range({DRAWS_AUC}) t(draw)),
rs as (select pk.draw, sc.* from pk join ix using (quality, idx) join sc on sc.doc_id = ix.doc_id),
a1 as ({auc_sql("draw", "s1", "rs")}), a2 as ({auc_sql("draw", "s2", "rs")})"""


@query("auc_bootstrap", AUCB_SQL + """
select 's1' model, draw, round(auc, 9)::double auc from a1
union all select 's2', draw, round(auc, 9)::double from a2""")
def auc_bootstrap(spark, sf):
    s = scores(spark, sf)
    long = s.select("doc_id", "quality", F.explode(F.array(
        F.struct(F.lit("s1").alias("model"), F.col("s1").alias("score")),
        F.struct(F.lit("s2").alias("model"), F.col("s2").alias("score")))).alias("e")).select(
        "doc_id", "quality", "e.*")
    return I.auc_bootstrap(materialize(long), "doc_id", "quality", DRAWS_AUC, "aucb", ["model"]
                           ).withColumn("auc", F.round("auc", 9))


@query("auc_delta_paired", AUCB_SQL + """
select count(*)::bigint n, round(quantile_cont(d, 0.5), 6) median_delta,
       avg((d <= 0)::int)::double p_not_better
from (select (a1.auc - a2.auc)::double d from a1 join a2 using (draw))""")
def auc_delta_paired(spark, sf):
    b = materialize(auc_bootstrap(spark, sf))
    d = b.groupBy("draw").agg((F.min(F.when(F.col("model") == "s1", F.col("auc")))
                               - F.min(F.when(F.col("model") == "s2", F.col("auc")))).alias("d"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("d", 0.5), 6).alias("median_delta"),
                 F.avg((F.col("d") <= 0).cast("int")).alias("p_not_better"))


@query("auc_delta_independent", SCORE_SQL + f""",
ix as (select doc_id, quality, row_number() over (partition by quality order by doc_id) - 1 idx,
         count(*) over (partition by quality) n from sc),
pa as (select draw, quality, (('0x' || substr(sha256('left|' || draw || '|' || quality || '|' || idx),
        1, 13))::bigint % n) idx from ix, range({DRAWS_AUC}) t(draw)),
pb as (select draw, quality, (('0x' || substr(sha256('right|' || draw || '|' || quality || '|' || idx),
        1, 13))::bigint % n) idx from ix, range({DRAWS_AUC}) t(draw)),
ra as (select pa.draw, sc.* from pa join ix using (quality, idx) join sc on sc.doc_id = ix.doc_id),
rb as (select pb.draw, sc.* from pb join ix using (quality, idx) join sc on sc.doc_id = ix.doc_id),
a1 as ({auc_sql("draw", "s1", "ra")}), a2 as ({auc_sql("draw", "s2", "rb")})
select draw, round((a1.auc - a2.auc)::double, 9) delta from a1 join a2 using (draw)""")
def auc_delta_independent(spark, sf):
    s = materialize(scores(spark, sf))
    a = I.auc_bootstrap(s.withColumn("score", F.col("s1")), "doc_id", "quality", DRAWS_AUC, "left")
    b = I.auc_bootstrap(s.withColumn("score", F.col("s2")), "doc_id", "quality", DRAWS_AUC, "right")
    return a.join(b.withColumnRenamed("auc", "b"), "draw").select(
        "draw", F.round(F.col("auc") - F.col("b"), 9).alias("delta"))


# ---- enrichment -----------------------------------------------------------------------

ENR_SQL = FEAT_SQL + sample_sql("null", "ps") + f""",
circ as (select distinct n_regionkey circuit from nation),
ec as (select f.sample_id, f.path_key, c.circuit, (select count(*) from
    (select unnest(f.nodes[1:-2]) u, unnest(f.nodes[2:]) v) z join nation a on a.n_nationkey = z.u
     join nation b on b.n_nationkey = z.v
     where a.n_regionkey = c.circuit and b.n_regionkey = c.circuit) n_edges from fs f, circ c),
ep as (select f.sample_id, f.path_key, c.circuit, (select count(*) from
    (select unnest(f.nodes[1:-2]) u, unnest(f.nodes[2:]) v) z join nation a on a.n_nationkey = z.u
     join nation b on b.n_nationkey = z.v
     where a.n_regionkey = c.circuit and b.n_regionkey = c.circuit) n_edges from ps f, circ c),
num as (select sample_id, path_key, row_number() over (partition by sample_id order by path_key) - 1 idx,
          count(*) over (partition by sample_id) psz from (select distinct sample_id, path_key from ep)),
pk as (select r.sample_id, draw, (('0x' || substr(sha256('enr|' || draw || '|' || r.path_key), 1, 13))::bigint
         % psz) idx
       from (select distinct sample_id, path_key from ec) r
       join (select distinct sample_id, psz from num) using (sample_id), range({DRAWS_NULL}) t(draw)),
nul as (select circuit, draw, avg(n_edges)::double nul from pk join num using (sample_id, idx)
        join ep using (sample_id, path_key) group by all),
ob as (select circuit, avg(n_edges)::double observed, count(*)::bigint n_paths from ec group by 1)
select circuit, n_paths, round(observed, 9) observed, round(avg(nul), 6) null_mean,
  round(case when avg(nul) > 0 then observed / avg(nul) end, 6) ratio,
  (1 + count(*) filter (nul >= observed - 1e-12))::double / {DRAWS_NULL + 1} p
from nul join ob using (circuit) group by circuit, n_paths, observed"""


def circuit_counts(paths, members):
    """Circuit edge counts of every path, zeros included."""
    got = G.circuit_edge_counts(paths, members)
    names = [r["circuit"] for r in members.select("circuit").distinct().collect()]  # few circuits
    every = paths.select("sample_id", "path_key", F.explode(
        F.array(*[F.lit(c) for c in sorted(names)])).alias("circuit"))
    return R.fill_keys(got, every, ["sample_id", "path_key", "circuit"], 0)


@query("enrichment", ENR_SQL)
def enrichment(spark, sf):
    members = materialize(fx.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("circuit")))
    graph = fx.dag(spark, sf)  # the shipments are read once for both samples
    _, _, real = sampled(spark, sf, "cand", graph=graph)
    _, _, pool = sampled(spark, sf, "null", graph=graph)
    e = I.enrichment(materialize(circuit_counts(real, members)), circuit_counts(pool, members),
                     "sample_id", "circuit", DRAWS_NULL, "enr")
    return e.select("circuit", "n_paths", F.round("observed", 9).alias("observed"),
                    F.round("null_mean", 6).alias("null_mean"), F.round("ratio", 6).alias("ratio"), "p")


@query("average_ranks", """
with c as (select o_orderstatus st, o_totalprice price, count(*)::bigint n_at from orders group by all)
select st, price, n_at,
  (sum(n_at) over (partition by st order by price) - n_at + (n_at + 1) / 2.0)::double avg_rank from c""")
def average_ranks(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("st"),
                                             F.col("o_totalprice").alias("price"))
    return value_ranks(o, ["st"], "price").select("st", "price", "n_at", "avg_rank")


@query("fold_size_summary", FOLD_SQL + """,
s as (select repeat, fold, sum(size)::double n from st join g using (grp) group by all)
select repeat, count(*)::bigint n_folds, min(n) min_n, quantile_cont(n, 0.25) q25,
  quantile_cont(n, 0.5) q50, quantile_cont(n, 0.75) q75, max(n) max_n from s group by repeat""")
def fold_size_summary(spark, sf):
    s = fold_sizes(spark, sf).select("repeat", F.col("n_rows").cast("double").alias("n"))
    return s.groupBy("repeat").agg(  # a handful of folds per repeat
        F.count(F.lit(1)).alias("n_folds"), F.min("n").alias("min_n"),
        *[F.percentile("n", q).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)],
        F.max("n").alias("max_n"))


@query("deterministic_shuffle", """
select o_orderkey, row_number() over (order by sha256('shuffle|' || o_orderkey), o_orderkey)::bigint pos
from orders""")
def deterministic_shuffle(spark, sf):
    from pathloom.functions.columns import hash_hex
    from pathloom.operators.ordered import row_position

    o = fx.table(spark, sf, "orders").select("o_orderkey").withColumn(
        "h", hash_hex("shuffle", F.col("o_orderkey")))
    return row_position(o, [], ["h", "o_orderkey"]).select("o_orderkey", "pos")


@query("mean_difference_bootstrap", f"""
with v as (select event_id, (event_type = 'click')::int y, round(value * 100) x from events
           where event_type in ('click', 'view')),
ix as (select *, row_number() over (partition by y order by event_id) - 1 idx,
         count(*) over (partition by y) n from v),
pk as (select draw, y, (('0x' || substr(sha256('md|' || draw || '|' || y || '|' || idx), 1, 13))::bigint
        % n) idx from ix, range({DRAWS_MEAN}) t(draw))
select draw, round(sum(x) filter (y = 1) / count(*) filter (y = 1)
  - sum(x) filter (y = 0) / count(*) filter (y = 0), 6) delta
from pk join ix using (y, idx) group by draw""")
def mean_difference_bootstrap(spark, sf):
    ev = fx.table(spark, sf, "events").where(F.col("event_type").isin("click", "view")).select(
        "event_id", (F.col("event_type") == "click").cast("int").alias("y"),
        F.round(F.col("value") * 100).alias("x"))
    return I.mean_difference_bootstrap(ev, "event_id", "y", "x", DRAWS_MEAN, "md").withColumn(
        "delta", F.round("delta", 6))
