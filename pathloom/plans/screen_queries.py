"""Screens over listed paths and over unconstrained walks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pathloom.operators import graph as G
from pathloom.operators import screens as S
from pathloom.plans import fixture as fx
from pathloom.plans.fixture import WITH_PATH
from pathloom.plans.registry import query
from pathloom.session import broadcast_if_small, materialize

# Screen parameters of the nation graph (13 of 25 nations form the first half).
PARAMS = S.ScreenParams(
    half=13, transition_max=2, velocity_lower=1.0, velocity_upper=60.0,
    bin_widths=(10.0, 25.0, 50.0), min_legal_bins=2, ratio_lower=5.0, ratio_upper=5.3)
RELAY = (3, 8, 17)  # nations allowed as the middle of an A-B-A pattern

VAR_SQL = " + ".join(f"list_aggregate({m}, 'var_pop') / 4.0" for m in fx.METRICS)
CUT_SQL = WITH_PATH + f""",
stat as (select *, round({VAR_SQL}, 9) st from path),
cut as (select quantile_cont(st, 0.5) c from stat where L >= 2)"""


def node_table(spark, sf):
    n = fx.table(spark, sf, "nation")
    return n.select(
        F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("network"),
        (F.col("n_nationkey") % 4).alias("lobe"), F.col("n_nationkey").isin(*RELAY).alias("relay"))


B1_SQL = WITH_PATH + f""",
reg as (select map(list(n_nationkey), list(n_regionkey)) m from nation),
lab as (select path_key, L, nodes, list_transform(nodes, lambda x: m[x]) net,
               list_transform(nodes, lambda x: x % 4) lobe from path, reg)
select path_key,
  case when len(list_filter(nodes, lambda x: (x < 13) <> (nodes[1] < 13))) > 0 then 'CROSS_HEMISPHERE'
       when len([1 for i in range(1, L + 1) if net[i] <> net[i+1]]) > 2
         then 'TOO_MANY_NETWORK_TRANSITIONS'
       when len([1 for i in range(1, L) if lobe[i] = lobe[i+2] and lobe[i] <> lobe[i+1]
                 and nodes[i+1] not in {RELAY}]) > 0 then 'LOBE_OSCILLATION' end reason
from lab"""


@query("screen_b1", B1_SQL)
def screen_b1(spark, sf):
    p = S.node_attributes(fx.paths(spark, sf), node_table(spark, sf),
                          ["network", "lobe", "relay"], ["path_key"])
    return S.apply_screen(p, "B1", PARAMS).select("path_key", F.col("reject_reason").alias("reason"))


@query("screen_b1_bonus", WITH_PATH + """
select path_key, count(a.n_nationkey)::bigint bonus
from (select path_key, unnest(nodes[1:-2]) u, unnest(nodes[2:]) v from path)
left join (select a.n_nationkey, b.n_nationkey m from nation a
           join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey) a
  on a.n_nationkey = u and a.m = v
group by path_key""")
def screen_b1_bonus(spark, sf):
    members = fx.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("circuit"))
    white = broadcast_if_small(G.whitelist_edges(members).withColumn("hit", F.lit(1)))
    e = G.path_edges(fx.paths(spark, sf), ["path_key"])
    return e.join(white, ["u", "v"], "left").groupBy("path_key").agg(
        F.count("hit").alias("bonus"))


@query("screen_b2", WITH_PATH + """
select path_key, case when len([1 for i in range(1, L+1) if lat[i+1] <= lat[i]]) > 0
    then 'NONPOSITIVE_LATENCY_DIFF'
  when len([1 for i in range(1, L+1) if tract[i] / (lat[i+1] - lat[i]) < 1.0
            or tract[i] / (lat[i+1] - lat[i]) > 60.0]) > 0 then 'VELOCITY_OUT_OF_RANGE' end reason
from path""")
def screen_b2(spark, sf):
    return S.apply_screen(fx.paths(spark, sf), "B2", PARAMS).select(
        "path_key", F.col("reject_reason").alias("reason"))


@query("screen_b3", WITH_PATH + """
select path_key, case when (
   (len([1 for i in range(1, L+1) if floor(lat[i+1]/10.0) <= floor(lat[i]/10.0)]) = 0)::int
 + (len([1 for i in range(1, L+1) if floor(lat[i+1]/25.0) <= floor(lat[i]/25.0)]) = 0)::int
 + (len([1 for i in range(1, L+1) if floor(lat[i+1]/50.0) <= floor(lat[i]/50.0)]) = 0)::int) < 2
 then 'INSUFFICIENT_BIN_CONSISTENCY' end reason
from path""")
def screen_b3(spark, sf):
    return S.apply_screen(fx.paths(spark, sf), "B3", PARAMS).select(
        "path_key", F.col("reject_reason").alias("reason"))


@query("screen_b4", WITH_PATH + """,
m as (select path_key, list_sum(w)::double / L mw from path)
select path_key, case when mw < (select quantile_cont(mw, 0.4) from m)
  then 'SC_BELOW_40TH_PERCENTILE' end reason from m""")
def screen_b4(spark, sf):
    p = materialize(fx.paths(spark, sf))
    cut = S.weight_cut(p, 0.4)
    return S.apply_screen(p, "B4", replace(PARAMS, mean_weight_min=cut)).select(
        "path_key", F.col("reject_reason").alias("reason"))


WALK_SQL = "with " + fx.EDGE_SQL + """,
onset as (select u seed, v node, lat from edge where lat > 0
  union all select u, u, 0.0::double from (select distinct u from edge)),
walk as (
  select a.u n1, a.v n2, b.v n3, a.mask m1, b.mask m2,
         (select lat from onset o where o.seed = a.u and o.node = a.v) l2,
         (select lat from onset o where o.seed = a.u and o.node = b.v) l3
  from edge a join edge b on b.u = a.v)"""


@query("screen_b5", WALK_SQL + """
select n1 || '|' || n2 || '|' || n3 path_key,
  case when n1 = n3 then 'REPEATED_ROI' when not m1 then 'SC_EDGE_ABSENT'
       when l2 is null or l2 <= 0 then 'NONSTRICT_TEMPORAL' when not m2 then 'SC_EDGE_ABSENT'
       when l3 is null or l3 <= l2 then 'NONSTRICT_TEMPORAL' end reason
from walk""")
def screen_b5(spark, sf):
    # two-edge walks over all pairs, masked or not, so every reason occurs
    e = materialize(fx.edges(spark, sf))
    hop = broadcast_if_small(e.select(F.col("u").alias("n2"), F.col("v").alias("n3")))
    walks = e.select(F.col("u").alias("n1"), F.col("v").alias("n2")).join(hop, "n2").select(
        F.array("n1", "n2", "n3").alias("nodes"),
        F.concat_ws("|", "n1", "n2", "n3").alias("path_key"))
    got = G.gather(walks, e.withColumn("edge_ok", F.col("mask")), ["path_key"],
                   ["edge_ok", *fx.METRICS])
    on = broadcast_if_small(G.onset_table(e))
    lat = (walks.select("path_key", F.element_at("nodes", 1).alias("seed"),
                        F.posexplode("nodes").alias("i", "node"))
           .join(on, ["seed", "node"], "left").groupBy("path_key")
           .agg(F.array_sort(F.collect_list(F.struct("i", "lat")))["lat"].alias("lat")))
    p = got.join(lat, "path_key")
    return S.apply_screen(p, "B5", PARAMS).select("path_key", F.col("reject_reason").alias("reason"))


@query("screen_b6", WITH_PATH + """
select path_key, case when list_avg(nav) / list_avg(rout) < 5.0
   or list_avg(nav) / list_avg(rout) > 5.3 then 'NAV_ROUT_RATIO_EXTREME' end reason from path""")
def screen_b6(spark, sf):
    return S.apply_screen(fx.paths(spark, sf), "B6", PARAMS).select(
        "path_key", F.col("reject_reason").alias("reason"))


def valid_paths(spark, sf):
    """Listed paths; their edges are masked by construction."""
    return fx.paths(spark, sf).withColumn("edge_ok", F.transform("w", lambda x: F.lit(True)))


def screened_s10(spark, sf):
    p = materialize(valid_paths(spark, sf))
    cut = S.complexity_cut(p, 0.5)
    return S.apply_screen(p, "S10", replace(PARAMS, complexity_min=cut)), cut


S10_CASE = "case when L >= 2 and st < (select c from cut) then 'VARIANCE_BELOW_MEDIAN' end"


@query("screen_s10", CUT_SQL + f"""
select path_key, round({VAR_SQL}, 6) stat, {S10_CASE} reason from stat""")
def screen_s10(spark, sf):
    p, _ = screened_s10(spark, sf)
    return p.select("path_key", F.round(S.complexity_stat(), 6).alias("stat"),
                    F.col("reject_reason").alias("reason"))


@query("screen_s14", WITH_PATH + """,
v as (select path_key, [tract[i] / (lat[i+1] - lat[i]) for i in range(1, L+1) if tract[i] > 0] v
      from path)
select path_key, case when len(v) > 0 and (list_aggregate(v, 'median') < 1.0
  or list_aggregate(v, 'median') > 60.0) then 'MEDIAN_VELOCITY_OUT_OF_RANGE' end reason from v""")
def screen_s14(spark, sf):
    return S.apply_screen(valid_paths(spark, sf), "S14", PARAMS).select(
        "path_key", F.col("reject_reason").alias("reason"))


ATTR_SQL = CUT_SQL + f""",
scr as (select *, {S10_CASE} reason from stat),
att as (select sample_id, seed, endpoint, L, count(*)::bigint n_candidate,
               count(*) filter (reason is null)::bigint n_accepted,
               count(*) filter (reason is not null)::bigint n_rej
        from scr group by all),
att2 as (select *, case when L = 1 then n_accepted >= 1 else n_accepted >= 5 end in_support
         from att)"""


@query("reject_breakdown", ATTR_SQL + """
select sample_id, n_candidate, n_accepted, n_rej n_rejected, in_support,
  case when n_rej = 0 then '{}' else '{"VARIANCE_BELOW_MEDIAN":' || n_rej || '}' end
    reject_reason_breakdown
from att2""")
def reject_breakdown(spark, sf):
    p, _ = screened_s10(spark, sf)
    return S.attrition(p, ["sample_id", "L"]).drop("L")


@query("support_rule", ATTR_SQL + """
select seed, endpoint, L, n_accepted, in_support,
       case when in_support then 'passed' when n_candidate = 0 then 'no_candidate'
            when not (case when L = 1 then n_candidate >= 1 else n_candidate >= 5 end)
              then 'insufficient_B5' else 'insufficient_variance' end support_class
from att2""")
def support_rule(spark, sf):
    p, _ = screened_s10(spark, sf)
    a = S.attrition(p, ["seed", "endpoint", "L"])
    return a.select("seed", "endpoint", "L", "n_accepted", "in_support", S.support_class(
        F.col("in_support"), F.col("n_candidate"), F.col("n_candidate"), F.col("L"))
        .alias("support_class"))


@query("path_support_by_length", ATTR_SQL + """
select L, count(*)::bigint n_cells, count(*) filter (in_support)::bigint n_supported,
       count(*) filter (in_support)::double / count(*) fraction
from att2 group by L""")
def path_support_by_length(spark, sf):
    p, _ = screened_s10(spark, sf)
    a = S.attrition(p, ["seed", "endpoint", "L"])
    return a.groupBy("L").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if("in_support").alias("n_supported"),
        (F.count_if("in_support") / F.count(F.lit(1))).alias("fraction"))


@query("retention_tables", ATTR_SQL + """
select 'length' by_what, L::bigint k, count(*) filter (in_support)::double / count(*) retained,
       sum(n_rej)::bigint n_rejected from att2 group by L
union all
select 'seed', seed::bigint, count(*) filter (in_support)::double / count(*),
       sum(n_rej)::bigint from att2 group by seed""")
def retention_tables(spark, sf):
    # both levels in one pass over the cells
    p, _ = screened_s10(spark, sf)
    a = S.attrition(p, ["seed", "endpoint", "L"])
    g = a.groupingSets([["L"], ["seed"]], "L", "seed").agg(
        F.grouping("L").alias("gl"),
        (F.count_if("in_support") / F.count(F.lit(1))).alias("retained"),
        F.sum("n_rejected").alias("n_rejected"))
    return g.select(F.when(F.col("gl") == 0, "length").otherwise("seed").alias("by_what"),
                    F.coalesce("L", "seed").cast("bigint").alias("k"), "retained", "n_rejected")


@query("top_reject_reasons", WALK_SQL + """
select coalesce(case when n1 = n3 then 'REPEATED_ROI' when not m1 then 'SC_EDGE_ABSENT'
       when l2 is null or l2 <= 0 then 'NONSTRICT_TEMPORAL' when not m2 then 'SC_EDGE_ABSENT'
       when l3 is null or l3 <= l2 then 'NONSTRICT_TEMPORAL' end, 'accepted') reason,
       count(*)::bigint n
from walk group by 1 order by n desc, reason limit 12""")
def top_reject_reasons(spark, sf):
    r = screen_b5(spark, sf).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))
    return r.orderBy(F.desc("n"), "reason").limit(12)  # fixed value: reasons of the report


@query("relaxed_ladder", CUT_SQL + """,
cutq as (select quantile_cont(st, 0.5) c5, quantile_cont(st, 0.3) c3 from stat where L >= 2),
cnt as (select sample_id, L,
   count(*) filter (L < 2 or st >= (select max(st) from stat)) n0,
   count(*) filter (L < 2 or st >= (select c5 from cutq)) n1,
   count(*) filter (L < 2 or st >= (select c3 from cutq)) n2, count(*) n3
   from stat group by all),
sup as (select count(*)::bigint n,
  count(*) filter (n0 >= case when L = 1 then 1 else 5 end)::bigint s0,
  count(*) filter (n1 >= case when L = 1 then 1 else 5 end)::bigint s1,
  count(*) filter (n2 >= case when L = 1 then 1 else 5 end)::bigint s2,
  count(*) filter (n3 >= case when L = 1 then 1 else 5 end)::bigint s3 from cnt),
r as (select 0 step, 'strict' as rule, n, s0 s from sup union all select 1, 'pool_median', n, s1 from sup
 union all select 2, 'pool_p30', n, s2 from sup union all select 3, 'none', n, s3 from sup)
select step, rule, n n_cells, s n_supported, s::double / n share,
  coalesce(step = (select min(step) from r where s >= 0.4 * n), false) chosen from r""")
def relaxed_ladder(spark, sf):
    from pathloom.operators.ordered import exact_quantiles

    p = materialize(fx.paths(spark, sf).select(
        "sample_id", "L", F.round(S.complexity_stat(), 9).alias("stat")))
    cuts = exact_quantiles(p.where("L >= 2"), [], "stat",
                           {"c5": 0.5, "c3": 0.3, "top": 1.0}).first()
    cells = p.select("sample_id", "L").distinct()
    top = p.agg(F.max("stat").alias("m")).first()["m"]
    return S.relaxed_ladder(p, cells, {"strict": top, "pool_median": cuts["c5"],
                                       "pool_p30": cuts["c3"], "none": None}, need=0.4)


@query("bin_width_sensitivity", "with recursive " + fx.PATH_SQL.replace(
    "select u seed, v node, lat from edge where lat > 0",
    "select u seed, v node, floor(lat / 25.0 + 0.5) * 25.0 lat from edge "
    "where floor(lat / 25.0 + 0.5) * 25.0 > 0") + """
select L, count(*)::bigint n_paths, count(distinct sample_id)::bigint n_cells from path group by L""")
def bin_width_sensitivity(spark, sf):
    # the search itself runs on the quantised latency: tied pairs lose their edge
    from pathloom.functions.columns import quantise

    e = fx.edges(spark, sf)
    q = e.withColumn("lat", quantise(F.col("lat"), 25.0))
    d = materialize(G.seed_dag(G.onset_table(q), q))
    return G.count_paths(d, fx.MAX_LEN).groupBy("L").agg(
        F.sum("cnt").alias("n_paths"), F.count(F.lit(1)).alias("n_cells"))


@query("density_mask_zeroing", WITH_PATH + """
select u, v, case when mask then nav else 0 end nav, case when mask then comm else 0 end comm
from edge""")
def density_mask_zeroing(spark, sf):
    e = fx.edges(spark, sf)
    return e.select("u", "v", *[F.when(F.col("mask"), F.col(m)).otherwise(0.0).alias(m)
                                for m in ("nav", "comm")])


@query("support_equality_audit", ATTR_SQL + """,
b0 as (select sample_id, L, count(*)::bigint n from path group by all),
b as (select sample_id, n, case when L = 1 then n >= 1 else n >= 5 end s from b0)
select count(*)::bigint n_both, 0::bigint n_left_only, 0::bigint n_right_only,
  count(*) filter (n_accepted <> n)::bigint n_diff_n_accepted,
  count(*) filter (in_support <> s)::bigint n_diff_in_support
from att2 join b using (sample_id)""")
def support_equality_audit(spark, sf):
    # support with the variance screen against support of the unscreened search
    from pathloom.operators.validation import equality_audit

    p, _ = screened_s10(spark, sf)
    p = materialize(p)
    screened = S.attrition(p, ["sample_id", "L"])
    plain = S.attrition(p.withColumn("reject_reason", F.lit(None).cast("string")), ["sample_id", "L"])
    return equality_audit(screened, plain, ["sample_id"], ["n_accepted", "in_support"])
