"""Exact permutation tests of targets, and random paths matched after diversity."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pathloom.functions.columns import arr_mean
from pathloom.operators import diversity as D
from pathloom.operators import graph as G
from pathloom.operators import nulls as N
from pathloom.operators import permutation as P
from pathloom.operators import screens as S
from pathloom.operators import similarity as Q
from pathloom.plans import fixture as fx
from pathloom.plans.cohort_queries import COLS, EMB_SQL, REFERENCE, vectors
from pathloom.plans.feature_queries import CELL, SAMPLE_K, sampled
from pathloom.plans.registry import query
from pathloom.plans.screen_queries import PARAMS
from pathloom.session import broadcast_if_small, materialize

TARGETS_SQL = EMB_SQL + """,
tv as (select label, case when label <= 2 then 0 when label <= 4 then 1 else 2 end cls, unnest([f1, f2, f3, f4]) x,
         unnest(range(4))::int i from mv where label <> 0),
c1 as (select distinct a.label a, b.label b from tv a join tv b on a.label < b.label),
lab as (select c1.a a1, c1.b b1, c2.a a2, c2.b b2 from c1 join c1 c2
        on c2.a not in (c1.a, c1.b) and c2.b not in (c1.a, c1.b)),
gs as (select a1, b1, a2, b2, i, case when label in (a1, b1) then 0 when label in (a2, b2) then 1 else 2 end c,
         count(*) n, avg(x) m, var_pop(x) * count(*) w from lab, tv group by all),
al as (select *, (a1 = 1 and b1 = 2 and a2 = 3 and b2 = 4) observed from gs)"""


def targets(spark, sf):
    """(label, cls, vec): one vector per target, classes of 2 / 2 / rest in label order."""
    m = Q.mean_vectors(vectors(spark, sf), "label", COLS).where(F.col("label") != REFERENCE)
    k = F.col("label")
    return materialize(m.select("label", F.when(k <= 2, 0).when(k <= 4, 1).otherwise(2).alias("cls"),
                                F.array(*COLS).alias("vec")))


@query("permanova_exact", TARGETS_SQL + """,
gm as (select a1, b1, a2, b2, i, sum(n * m) / sum(n) g from al group by all),
ft as (select a1, b1, a2, b2, observed, sum(n * (m - g)^2) b, sum(w) w, sum(n) filter (i = 0) n
       from al join gm using (a1, b1, a2, b2, i) group by all),
f as (select observed, round((b / 2) / (w / (n - 3)), 9) f from ft),
o as (select f fo from f where observed)
select round(fo, 6) pseudo_f, count(*)::bigint n_perm, count(*) filter (f >= fo)::bigint n_extreme,
  count(*) filter (f >= fo)::double / count(*) p_exact from f, o group by fo""")
def permanova_exact(spark, sf):
    p = P.permanova_exact(targets(spark, sf), "label", "cls", "vec")
    return p.withColumn("pseudo_f", F.round("pseudo_f", 6))


@query("contrast_exact", TARGETS_SQL + """,
md as (select a1, b1, a2, b2, observed, i, max(m) filter (c = 0) m0, max(m) filter (c = 1) m1, max(m) filter (c = 2) m2
       from al group by all),
d as (select observed, i, 0 a, 1 b, round(m0 - m1, 9) d from md union all
      select observed, i, 0, 2, round(m0 - m2, 9) from md),
o as (select i, a, b, d stat from d where observed)
select i, a, b, round(stat, 6) stat_obs, count(*)::bigint n_perm, count(*) filter (abs(d) >= abs(stat))::bigint n_extreme,
  count(*) filter (abs(d) >= abs(stat))::double / count(*) p_exact from d join o using (i, a, b) group by i, a, b, stat""")
def contrast_exact(spark, sf):
    p = P.contrast_exact(targets(spark, sf), "label", "cls", "vec", [(0, 1), (0, 2)])
    return p.withColumn("stat_obs", F.round("stat_obs", 6))


def matched_sets(spark, sf):
    """(screened and thinned targets, thinned pool without the screen), with the mean weight."""
    def thinned(paths):
        best = D.diverse_paths(paths, CELL).drop("pick")
        return materialize(best.join(paths, [*CELL, "nodes"]).select(*CELL, "path_key", arr_mean("w").alias("mean_w")))

    cut = S.complexity_cut(materialize(fx.paths(spark, sf)), 0.5)
    e, _, cand = sampled(spark, sf, "cand")
    cand = materialize(cand.withColumn("edge_ok", F.transform("w", lambda w: F.lit(True))))
    on, keys = materialize(G.onset_table(e)), [*CELL, "path_key"]
    lat = cand.select(*keys, F.posexplode("nodes").alias("i", "node")).join(
        broadcast_if_small(on), ["seed", "node"]).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("i", "lat")))["lat"].alias("lat"))  # one entry a node of the path
    scr = S.apply_screen(materialize(cand.join(lat, keys)), "S10", replace(PARAMS, complexity_min=cut))
    pool = materialize(sampled(spark, sf, "pool", 2 * SAMPLE_K)[2])
    return thinned(materialize(scr.where(F.col("reject_reason").isNull()))), thinned(pool)


@query("matched_random_ddvs")
def matched_random_ddvs(spark, sf):
    return N.match_greedy(*matched_sets(spark, sf), CELL)


@query("matched_random_ddvs_check", """
select unnest(['unmatched target', 'pool path used twice', 'not in the pool', 'nearer path was free']) finding, 0::bigint n""")
def matched_random_ddvs_check(spark, sf):
    """Every pair of ``matched_random_ddvs`` against the rule it was made by."""
    t, p = matched_sets(spark, sf)
    return N.match_findings(N.match_greedy(t, p, CELL), t, p, CELL)
