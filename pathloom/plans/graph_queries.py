"""Edge tables, DAGs and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions.columns import arr_mean, arr_sum
from pathloom.operators import graph as G
from pathloom.operators.ordered import exact_quantiles
from pathloom.plans import fixture as fx
from pathloom.plans.fixture import WITH_DAG, WITH_EDGE, WITH_PATH
from pathloom.plans.registry import query
from pathloom.session import materialize

SAMPLE_K = 512  # fixed value: paths sampled per cell


@query("edge_matrix", WITH_EDGE + """
select u, v, n, w, lat, y, tract, nav, rout, search, comm from edge""")
def edge_matrix(spark, sf):
    return fx.with_metrics(fx.edge_totals(spark, sf))


@query("edge_density_mask", WITH_EDGE + """
select u, v, w, mask from edge""")
def edge_density_mask(spark, sf):
    return fx.edges(spark, sf).select("u", "v", "w", "mask")


@query("matrix_audit", WITH_EDGE + """,
long as (select 'nav' metric, u, v, nav x from edge union all select 'rout', u, v, rout from edge
  union all select 'search', u, v, search from edge union all select 'comm', u, v, comm from edge),
nodes as (select distinct n_nationkey k from nation)
select metric, count(*)::bigint n_finite,
       ((select count(*) from nodes) * (select count(*) from nodes) - count(*))::bigint n_missing,
       round(min(x), 6) min_x, round(max(x), 6) max_x,
       round(quantile_cont(x, 0.05), 6) p05, round(quantile_cont(x, 0.95), 6) p95,
       count(*) filter (u = v)::bigint n_diagonal
from long group by metric""")
def matrix_audit(spark, sf):
    from pathloom.operators.commetrics import matrix_audit as audit
    from pathloom.plans.fixture import table

    n = table(spark, sf, "nation").select("n_nationkey").distinct().count()
    return audit(fx.with_metrics(fx.edge_totals(spark, sf)), list(fx.METRICS), n)


@query("matrix_compare", WITH_EDGE + """
select count(*)::bigint n_joint, round(max(abs(a.w - b.w))::double, 6) max_abs_diff,
       ((select count(*) from edge) - count(*))::bigint n_one_sided
from edge a join edge b on a.u = b.v and a.v = b.u""")
def matrix_compare(spark, sf):
    from pathloom.operators.commetrics import compare_matrices

    e = materialize(fx.edge_totals(spark, sf).select("u", "v", F.col("w").cast("double").alias("x")))
    back = e.select(F.col("v").alias("u"), F.col("u").alias("v"), "x")
    return compare_matrices(e, back).select(
        "n_joint", F.round("max_abs_diff", 6).alias("max_abs_diff"),
        F.col("n_left_only").alias("n_one_sided"))


@query("network_pairs", """
select distinct a.n_nationkey u, b.n_nationkey v
from nation a join nation b on a.n_regionkey = b.n_regionkey
where a.n_nationkey <> b.n_nationkey
  and exists (select 1 from supplier where s_nationkey = a.n_nationkey)
  and exists (select 1 from customer where c_nationkey = b.n_nationkey)""")
def network_pairs(spark, sf):
    members = fx.table(spark, sf, "nation").select(
        F.col("n_regionkey").alias("circuit"), F.col("n_nationkey").alias("node"))
    from_ = fx.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("u"))
    to = fx.table(spark, sf, "customer").select(F.col("c_nationkey").alias("v"))
    return (G.whitelist_edges(members).join(from_, "u", "left_semi")
            .join(to, "v", "left_semi").select("u", "v"))


@query("dag_edges", WITH_DAG + "select seed, u, v, lat_u, lat_v from dag")
def dag_edges(spark, sf):
    _, d = fx.dag(spark, sf)
    return d.select("seed", "u", "v", "lat_u", "lat_v")


@query("dag_edges_one_half", WITH_DAG + """
select seed, u, v from dag where (u < 13) = (seed < 13) and (v < 13) = (seed < 13)""")
def dag_edges_one_half(spark, sf):
    e = fx.edges(spark, sf)
    return G.seed_dag(G.onset_table(e), e, half=13).select("seed", "u", "v")


@query("dag_symmetric_mask", WITH_EDGE + """,
sym as (select a.u, a.v, a.mask or coalesce(b.mask, false) m from edge a
        left join edge b on a.u = b.v and a.v = b.u)
select u, v, m mask from sym""")
def dag_symmetric_mask(spark, sf):
    return G.symmetric_mask(fx.edges(spark, sf)).select("u", "v", "mask")


@query("path_counts_by_length", WITH_PATH + """
select L, count(*)::bigint n_paths, count(distinct sample_id)::bigint n_cells
from path group by L""")
def path_counts_by_length(spark, sf):
    _, d = fx.dag(spark, sf)
    return G.count_paths(d, fx.MAX_LEN).groupBy("L").agg(
        F.sum("cnt").alias("n_paths"), F.count(F.lit(1)).alias("n_cells"))


@query("path_count_dp", WITH_PATH + """
select seed, endpoint, L, count(*)::bigint cnt from path group by all""")
def path_count_dp(spark, sf):
    _, d = fx.dag(spark, sf)
    return G.count_paths(d, fx.MAX_LEN)


@query("path_enumerate", WITH_PATH + "select seed, endpoint, L, path_key from path")
def path_enumerate(spark, sf):
    return fx.paths(spark, sf).select("seed", "endpoint", "L", "path_key")


@query("path_registry", WITH_PATH + """
select sample_id, path_key, L,
       array_to_string([nodes[i] || '-' || nodes[i+1] for i in range(1, L+1)], ';') edge_set,
       row_number() over (partition by seed, endpoint, L order by nodes)::bigint path_rank
from path""")
def path_registry(spark, sf):
    # the rank of a path is its position among the children in node order, which
    # is the lexicographic order of the node arrays
    _, d = fx.dag(spark, sf)
    rest = materialize(G.remaining_counts(d, fx.MAX_LEN))
    ranks = rest.where("u = seed and rem > 0").select(
        "seed", "endpoint", F.col("rem").alias("L"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cnt") - 1)).alias("rank"))
    p = G.unrank(ranks, materialize(G.child_ranges(d, rest)), fx.MAX_LEN)
    return p.select(F.concat_ws("|", *G.CELL).alias("sample_id"),
                    F.array_join("nodes", "|").alias("path_key"), "L",
                    G.edge_set_text().alias("edge_set"), (F.col("rank") + 1).alias("path_rank"))


UNRANK_SQL = WITH_PATH + """
select seed, endpoint, L, path_key,
       (row_number() over (partition by seed, endpoint, L order by nodes) - 1)::bigint rnk
from path"""


@query("unrank_paths", UNRANK_SQL)
def unrank_paths(spark, sf):
    _, d = fx.dag(spark, sf)
    rest = materialize(G.remaining_counts(d, fx.MAX_LEN))
    totals = rest.where("u = seed and rem > 0").select(
        "seed", "endpoint", F.col("rem").alias("L"), "cnt")
    ranks = totals.select(*G.CELL, F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("cnt") - 1)).alias("rank"))
    ranks = G.check_ranks(ranks, totals).select(*G.CELL, "rank")
    return G.unrank(ranks, materialize(G.child_ranges(d, rest)), fx.MAX_LEN).select(
        *G.CELL, F.array_join("nodes", "|").alias("path_key"), F.col("rank").alias("rnk"))


SAMPLE_SQL = WITH_PATH + f""",
ranked as (
  select seed, endpoint, L, sample_id, path_key, nodes,
         (row_number() over (partition by seed, endpoint, L order by nodes) - 1)::bigint rnk,
         count(*) over (partition by seed, endpoint, L) total
  from path),
draw as (
  select distinct on (seed, endpoint, L, r) seed, endpoint, L, r, j from (
    select seed, endpoint, L, j,
           (('0x' || substr(sha256('cand|' || sample_id || '|' || j), 1, 13))::bigint
            % total)::bigint r
    from (select distinct seed, endpoint, L, sample_id, total from ranked
          where total > {4 * SAMPLE_K}), range({4 * SAMPLE_K}) t(j))
  order by seed, endpoint, L, r, j),
pick as (
  select seed, endpoint, L, rnk, sha256('cand|' || sample_id || '|' || rnk) h
  from ranked where total <= {4 * SAMPLE_K}
  union all select seed, endpoint, L, r, lpad(j::varchar, 12, '0') from draw),
chosen as (
  select * from (select *, row_number() over (partition by seed, endpoint, L order by h, rnk) i
                 from pick) where i <= {SAMPLE_K}),
samp as (select r.* from ranked r join chosen c using (seed, endpoint, L, rnk))"""


@query("rank_sample", SAMPLE_SQL + "select seed, endpoint, L, rnk, path_key from samp")
def rank_sample(spark, sf):
    _, d = fx.dag(spark, sf)
    return G.sampled_paths(d, fx.MAX_LEN, SAMPLE_K, "cand").select(
        *G.CELL, F.col("rank").alias("rnk"), F.array_join("nodes", "|").alias("path_key"))


# a cell with at most SAMPLE_K paths has all of them as candidates, walked or topped up
@query("random_walk_candidates", WITH_PATH + """
select seed, endpoint, L, path_key from path
qualify count(*) over (partition by seed, endpoint, L) <= """ + str(SAMPLE_K))
def random_walk_candidates(spark, sf):
    _, d = fx.dag(spark, sf)
    return G.random_walks(d, fx.MAX_LEN, SAMPLE_K, "walk").select(
        *G.CELL, F.array_join("nodes", "|").alias("path_key"))


@query("level_binned_paths", "with recursive " + fx.DAG_SQL + """,
lv as (select seed, node, dense_rank() over (partition by seed order by round_even(lat, 0)) k
       from onset where lat > 0),
walk as (
  select seed, [seed] nodes, seed cur, 0 k from (select distinct seed from onset)
  union all
  select w.seed, list_append(w.nodes, e.v), e.v, w.k + 1
  from walk w join edge e on e.u = w.cur and e.mask
  join lv on lv.seed = w.seed and lv.node = e.v and lv.k = w.k + 1),
p as (select seed, nodes, array_to_string(nodes, '|') s from walk where len(nodes) > 1)
select seed, s path_key from p a where not exists (
  select 1 from p b where b.seed = a.seed and len(b.nodes) > len(a.nodes)
  and contains('|' || b.s || '|', '|' || a.s || '|'))""")
def level_binned_paths(spark, sf):
    e = fx.edges(spark, sf)
    return G.level_paths(G.onset_table(e), e).select(
        "seed", F.array_join("nodes", "|").alias("path_key"))


@query("simple_path_prefixes", "with recursive " + fx.EDGE_SQL + """,
walk as (
  select u seed, [u] nodes, u cur, 0 L from (select distinct u from edge where mask)
  union all
  select w.seed, list_append(w.nodes, e.v), e.v, w.L + 1
  from walk w join edge e on e.u = w.cur and e.mask
  where w.L < 3 and not list_contains(w.nodes, e.v))
select seed, L, array_to_string(nodes, '|') path_key from walk where L > 0""")
def simple_path_prefixes(spark, sf):
    e = materialize(fx.edges(spark, sf).where("mask"))
    start = e.select(F.col("u").alias("seed")).distinct()
    return G.simple_paths(e, start, 3).select(
        "seed", "L", F.array_join("nodes", "|").alias("path_key"))


@query("path_mean_weight", WITH_PATH + """
select path_key, list_sum(w)::double / L mean_w from path""")
def path_mean_weight(spark, sf):
    return fx.paths(spark, sf).select(
        "path_key", arr_mean("w").alias("mean_w"))


@query("path_total_length_median", WITH_PATH + """
select sample_id, round(quantile_cont(list_sum(tract), 0.5), 6) median_len, count(*)::bigint n
from path group by sample_id""")
def path_total_length_median(spark, sf):
    p = fx.paths(spark, sf).select("sample_id", arr_sum("tract").alias("len"))
    n = p.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(p, ["sample_id"], "len", {"median_len": 0.5})
    return q.join(n, "sample_id").select(
        "sample_id", F.round("median_len", 6).alias("median_len"), "n")


@query("circuit_edges", WITH_PATH + """
select path_key, a.n_regionkey circuit, count(*)::bigint n_edges
from (select path_key, unnest(nodes[1:-2]) u, unnest(nodes[2:]) v from path)
join nation a on a.n_nationkey = u join nation b on b.n_nationkey = v
where a.n_regionkey = b.n_regionkey group by all""")
def circuit_edges(spark, sf):
    members = fx.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("circuit"))
    return G.circuit_edge_counts(fx.paths(spark, sf), members).select(
        "path_key", "circuit", "n_edges")


@query("edge_gather", WITH_PATH + """
select path_key, round(list_sum(nav), 6) nav_sum, round(list_max(comm), 6) comm_max from path""")
def edge_gather(spark, sf):
    e, d = fx.dag(spark, sf)
    listed = G.enumerate_paths(d.select("seed", "u", "v", "lat_u", "lat_v"), fx.MAX_LEN)
    got = G.gather(listed, e, ["path_key"], ["nav", "comm"])
    return got.select("path_key", F.round(arr_sum("nav"), 6).alias("nav_sum"),
                      F.round(F.array_max("comm"), 6).alias("comm_max"))
