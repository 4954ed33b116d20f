"""Diversity, features and null models over sampled path sets."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pathloom.functions.columns import arr_mean, arr_sum
from pathloom.operators import diversity as D
from pathloom.operators import features as V
from pathloom.operators import graph as G
from pathloom.operators import nulls as N
from pathloom.operators import screens as S
from pathloom.operators.ordered import exact_quantiles
from pathloom.plans import fixture as fx
from pathloom.plans.fixture import WITH_EDGE, WITH_PATH
from pathloom.plans.graph_queries import SAMPLE_K, SAMPLE_SQL
from pathloom.plans.registry import query
from pathloom.plans.screen_queries import ATTR_SQL, screened_s10
from pathloom.session import materialize

CELL = G.CELL


def sample_sql(tag: str, name: str) -> str:
    """The sampled path set ``name`` as CTEs after ``path``."""
    body = SAMPLE_SQL[len(WITH_PATH):].replace("cand|", f"{tag}|").replace(
        "select seed, endpoint, L, sample_id, path_key, nodes,",
        "select seed, endpoint, L, sample_id, path_key, nodes, w, tract, nav, rout, search, comm,")
    body = re.sub(r"\b(ranked|draw|pick|chosen|samp)\b", name + r"_\1", body)
    return body.replace(f"{name}_samp as", f"{name} as")


FEAT_SQL = WITH_PATH + sample_sql("cand", "fs")


def sampled(spark, sf, tag="cand", k=SAMPLE_K, graph=None):
    """(edges, DAG, sampled paths with edge attributes); ``graph`` are edges and DAG if known."""
    e, d = graph or fx.dag(spark, sf)
    p = G.sampled_paths(d, fx.MAX_LEN, k, tag)
    got = G.gather(p, e, CELL, ["w", "tract", *fx.METRICS])
    return e, d, got.withColumn("sample_id", F.concat_ws("|", *CELL)).withColumn(
        "path_key", F.array_join("nodes", "|"))


@query("path_dedup", FEAT_SQL + sample_sql("dup", "gs") + """
select sample_id, path_key, min(src)::int first_source
from (select sample_id, path_key, 0 src from fs union all
      select sample_id, path_key, 1 from gs) group by all""")
def path_dedup(spark, sf):
    _, d = fx.dag(spark, sf)
    a = G.sampled_paths(d, fx.MAX_LEN, SAMPLE_K, "cand").withColumn("src", F.lit(0))
    b = G.sampled_paths(d, fx.MAX_LEN, SAMPLE_K, "dup").withColumn("src", F.lit(1))
    u = D.dedup(a.unionByName(b).drop("rank"), CELL, "src")
    return u.select(F.concat_ws("|", *CELL).alias("sample_id"),
                    F.array_join("nodes", "|").alias("path_key"), F.col("src").alias("first_source"))


@query("edge_jaccard", FEAT_SQL + """,
es as (select sample_id, path_key, L, [nodes[i] || '-' || nodes[i+1] for i in range(1, L+1)] es
       from fs),
j as (select a.sample_id, a.path_key a, b.path_key b,
        len(list_intersect(a.es, b.es))::double / (2 * a.L - len(list_intersect(a.es, b.es))) jaccard
      from es a join es b on a.sample_id = b.sample_id and a.path_key < b.path_key)
select * from j where jaccard >= 0.25 - 1e-12""")
def edge_jaccard(spark, sf):
    _, d = fx.dag(spark, sf)
    p = G.sampled_paths(d, fx.MAX_LEN, SAMPLE_K, "cand").select(
        F.concat_ws("|", *CELL).alias("sample_id"), "nodes",
        F.array_join("nodes", "|").alias("path_key"))
    return D.similar_pairs(p, ["sample_id"], "path_key", 0.25)


@query("pathset_jaccard", FEAT_SQL + sample_sql("dup", "gs") + """,
u as (select sample_id, path_key, max(a) a, max(b) b from (
  select sample_id, path_key, 1 a, 0 b from fs union all select sample_id, path_key, 0, 1 from gs)
  group by all)
select sample_id, sum(a)::bigint n_a, sum(b)::bigint n_b, sum(a*b)::bigint n_both,
       count(*)::bigint n_union, sum(a*b)::double / count(*) jaccard from u group by sample_id""")
def pathset_jaccard(spark, sf):
    _, d = fx.dag(spark, sf)
    tag = lambda t: G.sampled_paths(d, fx.MAX_LEN, SAMPLE_K, t).select(
        F.concat_ws("|", *CELL).alias("sample_id"), F.array_join("nodes", "|").alias("path_key"))
    return D.set_overlap(tag("cand"), tag("dup"), ["sample_id"], "path_key")


@query("diverse_selection")
def diverse_selection(spark, sf):
    _, d = fx.dag(spark, sf)
    p = G.sampled_paths(d, fx.MAX_LEN, SAMPLE_K, "ddvs")
    return D.diverse_paths(p, CELL).select(
        *CELL, F.array_join("nodes", "|").alias("path_key"), "pick")


def _stat_sql(m: str) -> list[str]:
    return [f"list_avg({m}) {m}_mean", f"list_aggregate({m}, 'stddev_pop') {m}_std",
            f"list_min({m}) {m}_min", f"list_max({m}) {m}_max", f"{m}[1] {m}_first",
            f"{m}[L] {m}_last",
            f"case when L < 2 then 0.0 else (select regr_slope(x, (i - 1)::double / (L - 1)) "
            f"from (select unnest({m}) x, unnest(range(1, L + 1)) i)) end {m}_slope"]


def _med_iqr(n: str) -> str:
    return (f"round(quantile_cont({n}, 0.5), 6) {n}_med, "
            f"round(quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25), 6) {n}_iqr")


def rounded(df, keys, digits=6):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in df.columns if c not in keys])


BLIND = [f"{m}_{s}" for m in fx.METRICS for s in V.STATS]


@query("blind_stats", FEAT_SQL + ", st as (select seed, endpoint, L, "
       + ", ".join(x for m in fx.METRICS for x in _stat_sql(m)) + " from fs) "
       + "select seed, endpoint, L, " + ", ".join(map(_med_iqr, BLIND))
       + " from st group by seed, endpoint, L")
def blind_stats(spark, sf):
    _, _, p = sampled(spark, sf)
    return rounded(V.blind_stats(p, CELL), CELL)


def _weights_sql() -> str:
    rows = []
    for L, w in enumerate(V.basis_weights(fx.MAX_LEN), 1):
        for q in range(V.DEGREES):
            rows.append(f"({L}, {q}, {[float(x) for x in w[q]]}::double[])")
    return "wt(wl, q, wts) as (values " + ", ".join(rows) + ")"


OB = [f"ob_{m}_p{q}" for m in fx.METRICS for q in range(V.DEGREES)]


def _ob_sql(series: dict[str, str]) -> str:
    return ", ob as (select seed, endpoint, L, path_key, " + ", ".join(
        f"list_dot_product({series[m]}, (select wts from wt where wl = L and q = {q})) ob_{m}_p{q}"
        for m in fx.METRICS for q in range(V.DEGREES))


@query("legendre_features", FEAT_SQL + ", " + _weights_sql()
       + _ob_sql({m: m for m in fx.METRICS}) + " from fs) select seed, endpoint, L, "
       + ", ".join(map(_med_iqr, OB)) + " from ob group by seed, endpoint, L")
def legendre_features(spark, sf):
    _, _, p = sampled(spark, sf)
    return rounded(V.legendre_features(p, CELL, fx.MAX_LEN), CELL)


@query("c4_block", WITH_PATH + ", cell as (select distinct seed, endpoint, L from path) "
       + "select seed, endpoint, cell.L L, "
       + ", ".join(f"case when cell.L = {k} then 1.0 else 0.0 end::double L_{k}"
                   for k in range(1, V.MAX_EDGES + 1))
       + ", " + ", ".join(f"e.{m} ep_{m}" for m in fx.METRICS)
       + " from cell left join edge e on e.u = seed and e.v = endpoint")
def c4_block(spark, sf):
    e, d = fx.dag(spark, sf)
    return V.endpoint_block(G.count_paths(d, fx.MAX_LEN).select(*CELL), e)


@query("design_matrix", FEAT_SQL + ", " + _weights_sql()
       + _ob_sql({m: m for m in fx.METRICS}) + " from fs), f as (select seed, endpoint, L, "
       + ", ".join(map(_med_iqr, OB)) + " from ob group by seed, endpoint, L) "
       + "select f.seed, f.endpoint, f.L, "
       + ", ".join(f"case when f.L = {k} then 1.0 else 0.0 end::double L_{k}"
                   for k in range(1, fx.MAX_LEN + 1))
       + ", " + ", ".join(f"e.{m} ep_{m}" for m in fx.METRICS)
       + ", " + ", ".join(f"{n}_med, {n}_iqr" for n in OB)
       + " from f left join edge e on e.u = f.seed and e.v = f.endpoint")
def design_matrix(spark, sf):
    e, d, p = sampled(spark, sf)
    ob = rounded(V.legendre_features(p, CELL, fx.MAX_LEN), CELL)
    c4 = V.endpoint_block(G.count_paths(d, fx.MAX_LEN).select(*CELL), e, fx.MAX_LEN)
    return V.assemble(c4, [ob], CELL)


@query("mode_shares", FEAT_SQL + """,
sh as (select seed, endpoint, L, round((""" + " + ".join(
    f"list_max({m}) / list_sum({m})" for m in fx.METRICS[:3])
    + """ + coalesce(case when list_sum(comm) > 0 then list_max(comm) / list_sum(comm) end, 0))
   / (3 + (list_sum(comm) > 0)::int), 9) s from fs)
select seed, endpoint, L, count(*) filter (s > 2.0/3.0)::double / count(*) share_routing,
  count(*) filter (s < 1.0/3.0)::double / count(*) share_diffusion,
  count(*) filter (not (s > 2.0/3.0 or s < 1.0/3.0))::double / count(*) share_partial
from sh group by all""")
def mode_shares(spark, sf):
    _, _, p = sampled(spark, sf)
    return V.mode_shares(p, CELL)


@query("coverage", ATTR_SQL + """
select seed, count(distinct endpoint) filter (in_support)::bigint n_kept,
  count(distinct endpoint)::bigint n_all,
  count(distinct endpoint) filter (in_support)::double / count(distinct endpoint) coverage
from att2 group by seed""")
def coverage(spark, sf):
    p, _ = screened_s10(spark, sf)
    cells = materialize(S.attrition(p, CELL).select(*CELL, "in_support"))
    return V.coverage(cells.where("in_support"), cells)


@query("confounder_block", WITH_PATH + ", c as (select seed, endpoint, L, count(*) n from path "
       "group by all) select seed, endpoint, L, "
       + ", ".join(f"case when a.n_regionkey = {k} then 1.0 else 0.0 end::double seed_net_{k}, "
                   f"case when b.n_regionkey = {k} then 1.0 else 0.0 end::double end_net_{k}"
                   for k in range(5))
       + ", round(ln(n + 1), 6) log_paths from c join nation a on a.n_nationkey = seed "
       "join nation b on b.n_nationkey = endpoint")
def confounder_block(spark, sf):
    _, d = fx.dag(spark, sf)
    net = fx.nation_region(spark, sf).select("node", "network")
    c = G.count_paths(d, fx.MAX_LEN)
    c = c.join(net.toDF("seed", "na"), "seed").join(net.toDF("endpoint", "nb"), "endpoint")
    nets = list(range(5))
    return c.select(*CELL, *V.network_dummies(F.col("na"), nets, "seed_net_"),
                    *V.network_dummies(F.col("nb"), nets, "end_net_"),
                    F.round(F.log(F.col("cnt") + 1), 6).alias("log_paths"))


@query("feature_qc", WITH_PATH + ", cell as (select distinct seed, endpoint, L from path), "
       "f as (select cell.L::double l_val, e.nav, e.rout, case when e.mask then 1.0 end::double fixed "
       "from cell left join edge e on e.u = seed and e.v = endpoint) "
       + " union all ".join(
           f"select '{c}' feature, count(*) filter ({c} is null)::bigint n_missing, "
           f"0::bigint n_infinite, round(var_pop(coalesce({c}, (select quantile_cont({c}, 0.5) "
           f"from f))), 12) = 0 zero_variance from f" for c in ("l_val", "nav", "rout", "fixed")))
def feature_qc(spark, sf):
    e, d = fx.dag(spark, sf)
    c = G.count_paths(d, fx.MAX_LEN).select(*CELL)
    pair = e.select(F.col("u").alias("seed"), F.col("v").alias("endpoint"), "nav", "rout",
                    F.when(F.col("mask"), 1.0).alias("fixed"))
    f = materialize(c.join(pair, ["seed", "endpoint"], "left").withColumn(
        "l_val", F.col("L").cast("double")))
    return V.feature_qc(f, ["l_val", "nav", "rout", "fixed"])


# ---- null models -------------------------------------------------------------


@query("order_shuffle", FEAT_SQL + """,
tr as (select path_key, nodes, t,
   [nodes[1]] || list_transform(list_sort(list_transform(nodes[2:-2],
      lambda x: sha256('ord|' || path_key || '|' || t || '|' || x) || '#' || x)),
      lambda s: split_part(s, '#', 2)::int) || [nodes[-1]] cand
   from fs, range(20) r(t) where L > 2),
ok as (select path_key, t, cand from tr where cand <> nodes
   and not exists (select 1 from (select unnest(cand[1:-2]) a, unnest(cand[2:]) b) z
      left join edge e on e.u = z.a and e.v = z.b and e.mask where e.u is null)),
best as (select path_key, arg_min(cand, t) cand from ok group by path_key)
select f.path_key, array_to_string(coalesce(b.cand, f.nodes), '|') shuffled,
  case when L <= 2 then 'no_interior' when b.cand is null then 'fallback' else 'shuffled' end kind
from fs f left join best b using (path_key)""")
def order_shuffle(spark, sf):
    e, d = fx.dag(spark, sf)
    p = materialize(G.sampled_paths(d, fx.MAX_LEN, SAMPLE_K, "cand").select(
        "nodes", F.array_join("nodes", "|").alias("path_key")))
    return N.order_shuffle(p, e.where("mask"), "path_key", "ord").select(
        "path_key", F.array_join("shuffled", "|").alias("shuffled"), "kind")


@query("order_shuffle_by_fold", FEAT_SQL + """,
tr as (select path_key, nodes, r, f, t,
   [nodes[1]] || list_transform(list_sort(list_transform(nodes[2:-2],
      lambda x: sha256('fold|' || r || '|' || f || '|' || path_key || '|' || t || '|' || x)
        || '#' || x)), lambda s: split_part(s, '#', 2)::int) || [nodes[-1]] cand
   from fs, range(5) rr(r), range(5) ff(f), range(20) q(t) where L > 2),
ok as (select path_key, r, f, t, cand from tr where cand <> nodes
   and not exists (select 1 from (select unnest(cand[1:-2]) a, unnest(cand[2:]) b) z
      left join edge e on e.u = z.a and e.v = z.b and e.mask where e.u is null)),
best as (select path_key, r, f, arg_min(cand, t) cand from ok group by all)
select r::int repeat, f::int fold, count(*)::bigint n_paths,
       count(distinct array_to_string(cand, '|'))::bigint n_orders
from best group by r, f""")
def order_shuffle_by_fold(spark, sf):
    # one realisation per (repeat, fold): the fold is part of the path key
    e, d = fx.dag(spark, sf)
    p = G.sampled_paths(d, fx.MAX_LEN, SAMPLE_K, "cand")
    p = p.select("nodes", F.array_join("nodes", "|").alias("pk"),
                 F.explode(F.sequence(F.lit(0), F.lit(fx.REPEATS * fx.FOLDS - 1))).alias("i"))
    r, f = F.floor(F.col("i") / fx.FOLDS).cast("int"), (F.col("i") % fx.FOLDS).cast("int")
    p = materialize(p.select("nodes", F.concat_ws("|", r, f, "pk").alias("path_key")))
    s = N.order_shuffle(p, e.where("mask"), "path_key", "fold").where("kind = 'shuffled'")
    part = F.split("path_key", r"\|")
    return s.groupBy(part[0].cast("int").alias("repeat"), part[1].cast("int").alias("fold")).agg(
        F.count(F.lit(1)).alias("n_paths"), F.countDistinct("shuffled").alias("n_orders"))


EDGE_PERM_SQL = """,
tr as (select path_key, L, t, list_transform(list_sort(list_transform(range(L),
      lambda x: sha256('edge|' || path_key || '|' || t || '|' || x) || '#' || x)),
      lambda s: split_part(s, '#', 2)::int) ord
   from fs, range(20) q(t) where L >= 2),
perm as (select path_key, arg_min(ord, t) ord from tr
         where ord <> list_transform(range(L), lambda x: x::int) group by path_key),
pp as (select f.*, coalesce(p.ord, list_transform(range(L), lambda x: x::int)) ord
       from fs f left join perm p using (path_key))"""


def _with_order(p):
    return p.withColumn("ord", N.edge_order(F.col("L"), "edge", F.col("path_key")))


@query("edge_shuffle", FEAT_SQL + EDGE_PERM_SQL + """
select path_key, array_to_string(ord, '|') edge_order from pp""")
def edge_shuffle(spark, sf):
    _, _, p = sampled(spark, sf)
    return _with_order(p).select("path_key", F.array_join("ord", "|").alias("edge_order"))


@query("legendre_edge_shuffled", FEAT_SQL + EDGE_PERM_SQL + ", " + _weights_sql()
       + _ob_sql({m: f"list_transform(ord, lambda i: {m}[i + 1])" for m in fx.METRICS})
       + " from pp) select seed, endpoint, L, " + ", ".join(map(_med_iqr, OB))
       + " from ob group by seed, endpoint, L")
def legendre_edge_shuffled(spark, sf):
    _, _, p = sampled(spark, sf)
    p = _with_order(p)
    p = p.select(*CELL, *[N.permute(m, "ord").alias(m) for m in fx.METRICS])
    return rounded(V.legendre_features(p, CELL, fx.MAX_LEN), CELL)


@query("latency_null", fx.WITH_DAG + """,
ins as (select * from onset where (node < 13) = (seed < 13) and node <> seed),
a as (select seed, node, row_number() over (partition by seed order by node) i from ins),
b as (select seed, lat, row_number() over (partition by seed
      order by sha256('lat|' || seed || '|' || node), node) i from ins)
select a.seed, a.node, b.lat from a join b using (seed, i)""")
def latency_null(spark, sf):
    return N.latency_permutation(G.onset_table(fx.edges(spark, sf)), 13, "lat")


@query("latency_null_search", "with recursive " + fx.DAG_SQL + f""",
ins as (select * from onset where (node < 13) = (seed < 13) and node <> seed),
a as (select seed, node, row_number() over (partition by seed order by node) i from ins),
b as (select seed, lat, row_number() over (partition by seed
      order by sha256('lat|' || seed || '|' || node), node) i from ins),
o2 as (select a.seed, a.node, b.lat from a join b using (seed, i)
       union all select seed, node, lat from onset where node = seed),
d2 as (select x.seed, e.u, e.v from o2 x join edge e on e.u = x.node and e.mask
       join o2 y on y.seed = x.seed and y.node = e.v where y.lat > x.lat),
walk2 as (
  select seed, v node, 1 L from d2 where u = seed
  union all
  select k.seed, d.v, k.L + 1 from walk2 k join d2 d on d.seed = k.seed and d.u = k.node
  where k.L < {fx.MAX_LEN})
select L, count(*)::bigint n_paths from walk2 group by L""")
def latency_null_search(spark, sf):
    # the search reruns on the permuted latencies
    e = fx.edges(spark, sf)
    on = materialize(G.onset_table(e))
    null = N.latency_permutation(on, 13, "lat").unionByName(on.where("node = seed"))
    d = materialize(G.seed_dag(materialize(null), e))
    return G.count_paths(d, fx.MAX_LEN).groupBy("L").agg(F.sum("cnt").alias("n_paths"))


@query("sc_rewire")
def sc_rewire(spark, sf):
    e = fx.edges(spark, sf)
    return N.rewire(e, 13, "rewire")


@query("sc_rewire_degrees", WITH_EDGE + """,
und as (select distinct u < 13 l, least(u, v) a, greatest(u, v) b from edge where mask and (u < 13) = (v < 13))
select l as "left", node, count(*)::bigint degree from (select l, a node from und union all select l, b from und)
group by all""")
def sc_rewire_degrees(spark, sf):
    """Degrees after rewiring, which are those before it."""
    e = sc_rewire(spark, sf)
    ends = e.select("left", F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("left", "node").agg(F.count(F.lit(1)).alias("degree"))


@query("matched_random")
def matched_random(spark, sf):
    _, _, t = sampled(spark, sf, "cand")
    _, _, p = sampled(spark, sf, "pool", 2 * SAMPLE_K)  # else a full cell leaves no choice
    keep = lambda x: x.select(*CELL, "path_key", arr_mean("w").alias("mean_w"))
    return N.match_greedy(keep(t), keep(p), CELL)


@query("matched_random_walks")
def matched_random_walks(spark, sf):
    e, _, p = sampled(spark, sf)
    lens = materialize(p.select(*CELL, arr_sum("tract").alias("len")))
    med = exact_quantiles(lens, CELL, "len", {"med_len": 0.5})
    cells = med.join(lens.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_paths")), CELL)
    cells = materialize(cells)
    walks = materialize(N.matched_walks(cells, e, 13, "mrw"))
    return N.with_shortfall(cells, walks).select(
        *CELL, "t", F.array_join("nodes", "|").alias("path_key"), F.round("len", 6).alias("len"),
        "shortfall")
