"""Null models that search and screen again: exchanged edges and permuted latencies."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from pathloom.operators import graph as G
from pathloom.operators import nulls as N
from pathloom.operators import screens as S
from pathloom.plans import fixture as fx
from pathloom.plans.feature_queries import sample_sql
from pathloom.plans.graph_queries import SAMPLE_K
from pathloom.plans.registry import query
from pathloom.plans.screen_queries import CUT_SQL, PARAMS, VAR_SQL
from pathloom.session import broadcast_if_small, materialize

HALF = 13

EXCHANGE_SQL = """
und as (select distinct u < 13 l, least(u, v) a, greatest(u, v) b from edge where mask and (u < 13) = (v < 13)),
st as (
  select 0 t, l, a, b, 0::bigint done, count(*) over (partition by l) m from und
  union all
  (with e as (select * from st where done < 4 * m and t < 80),
   pl as (select *, row_number() over (partition by l order by sha256('sc|' || t || '|' || a || '|' || b), a, b) - 1 i from e),
   pr as (select l, i // 2 pair, min(t) t, min(done) done, min(m) m, arg_min(a, i) xa, arg_min(b, i) xb, arg_max(a, i) ya,
            arg_max(b, i) yb, count(*) k from pl group by l, i // 2),
   fl as (select *, ('0x' || substr(sha256('sc|flip|' || t || '|' || xa || '|' || xb), 1, 13))::bigint % 2 f from pr),
   sw as (select *, case when f = 1 then yb else ya end c, case when f = 1 then ya else yb end d from fl),
   nw as (select *, least(xa, d) n1a, greatest(xa, d) n1b, least(c, xb) n2a, greatest(c, xb) n2b,
            k = 2 and len(list_distinct([xa, xb, ya, yb])) = 4 ok from sw),
   cl as (select l, pair, n1a a, n1b b from nw where ok union all select l, pair, n2a, n2b from nw where ok
          union all select l, null, a, b from e),
   fr as (select l, max(pair) pair from cl group by l, a, b having count(*) = 1 and max(pair) is not null),
   ac as (select l, pair from fr group by l, pair having count(*) = 2),
   dn as (select l, count(*) got from ac group by l)
   select t + 1, nw.l, unnest(case when ac.pair is not null then [n1a, n2a] when k = 2 then [xa, ya] else [xa] end),
     unnest(case when ac.pair is not null then [n1b, n2b] when k = 2 then [xb, yb] else [xb] end),
     done + coalesce(got, 0), m
   from nw left join ac on ac.l = nw.l and ac.pair = nw.pair left join dn on dn.l = nw.l)),
exch as (select l, a, b from (select *, max(t) over (partition by l) last from st) where t = last)"""

EDGE2_SQL = """,
edge2 as (select e.* replace (case when (u < 13) = (v < 13) then x.a is not null else mask end as mask)
  from edge e left join exch x on x.a = least(u, v) and x.b = greatest(u, v)),
onset2 as (select * from onset)"""

LAT2_SQL = """,
ins as (select * from onset where (node < 13) = (seed < 13) and node <> seed),
la as (select seed, node, row_number() over (partition by seed order by node) i from ins),
lb as (select seed, lat, row_number() over (partition by seed order by sha256('lat|' || seed || '|' || node), node) i from ins),
onset2 as (select la.seed, la.node, lb.lat from la join lb using (seed, i) union all select seed, node, lat from onset where node = seed),
edge2 as (select * from edge)"""


def again(sql: str) -> str:
    """The search of ``sql`` on the second graph: its CTEs with a 2 behind their names."""
    return re.sub(r"\b(onset|edge|dag|walk|path)\b", r"\g<1>2", sql)


SEARCH2_SQL = "," + again(fx.PATH_SQL[fx.PATH_SQL.index("dag as ("):])
SCREEN2_SQL = again(sample_sql("null2", "cs")) + f""",
st2 as (select seed, endpoint, L, round({VAR_SQL}, 9) s2 from cs)
select seed, endpoint, L, count(*)::bigint n_candidate,
  count(*) filter (L = 1 or s2 >= (select c from cut))::bigint n_accepted from st2 group by all"""


def null_graph(spark, sf, which):
    """(edges, onsets) of the null model."""
    e = fx.edges(spark, sf)
    on = materialize(G.onset_table(e))
    if which == "exchange":
        return materialize(N.rewired_mask(e, HALF, "sc")), on
    return e, materialize(N.latency_permutation(on, HALF, "lat").unionByName(on.where("node = seed")))


def screened_again(spark, sf, which):
    """Attrition of the candidates of every cell of the null graph under the S10 rule, whose
    constant stays that of the real graph."""
    cut = S.complexity_cut(materialize(fx.paths(spark, sf)), 0.5)
    e, on = null_graph(spark, sf, which)
    d = materialize(G.seed_dag(on, e))
    p = materialize(G.sampled_paths(d, fx.MAX_LEN, SAMPLE_K, "null2").withColumn("path_key", F.array_join("nodes", "|")))
    keys = [*G.CELL, "path_key"]
    lat = p.select(*keys, F.posexplode("nodes").alias("i", "node")).join(broadcast_if_small(on), ["seed", "node"]).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("i", "lat")))["lat"].alias("lat"))  # one entry a node of the path
    p = G.gather(p, e.withColumn("edge_ok", F.col("mask")), keys, ["edge_ok", "w", "tract", *fx.METRICS])
    p = materialize(p.join(lat, keys))
    scr = S.apply_screen(p, "S10", replace(PARAMS, complexity_min=cut))
    return scr.groupBy(*G.CELL).agg(F.count(F.lit(1)).alias("n_candidate"),
                                    F.count_if(F.col("reject_reason").isNull()).alias("n_accepted"))


@query("sc_exchange", "with recursive " + fx.EDGE_SQL + "," + EXCHANGE_SQL + """
select l as "left", a, b from exch""")
def sc_exchange(spark, sf):
    e = fx.edges(spark, sf).where(F.col("mask") & ((F.col("u") < HALF) == (F.col("v") < HALF)))
    return N.exchange_rounds(e.select((F.col("u") < HALF).alias("left"), F.col("u").alias("a"), F.col("v").alias("b")), "left", "sc")


@query("sc_null_search", "with recursive " + fx.DAG_SQL + "," + EXCHANGE_SQL + EDGE2_SQL + SEARCH2_SQL + """
select L, count(*)::bigint n_paths, count(distinct seed || '|' || node)::bigint n_pairs from walk2 group by L""")
def sc_null_search(spark, sf):
    """Paths of the exchanged graph by length: the search runs again on it."""
    e, on = null_graph(spark, sf, "exchange")
    n = G.count_paths(materialize(G.seed_dag(on, e)), fx.MAX_LEN)
    return n.groupBy("L").agg(F.sum("cnt").alias("n_paths"), F.count(F.lit(1)).alias("n_pairs"))


@query("sc_null_screen", CUT_SQL + "," + EXCHANGE_SQL + EDGE2_SQL + SEARCH2_SQL + SCREEN2_SQL)
def sc_null_screen(spark, sf):
    return screened_again(spark, sf, "exchange")


@query("latency_null_screen", CUT_SQL + LAT2_SQL + SEARCH2_SQL + SCREEN2_SQL)
def latency_null_screen(spark, sf):
    return screened_again(spark, sf, "latency")
