"""Communication metrics, signals and geometry."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pathloom.operators import commetrics as M
from pathloom.operators import geometry as Geo
from pathloom.operators import graph as G
from pathloom.operators import signals as Sg
from pathloom.plans import fixture as fx
from pathloom.plans.fixture import WITH_EDGE
from pathloom.plans.registry import query
from pathloom.session import materialize

TERMS = 20  # Taylor terms; norms are at most 1, so the rest is below 1 / 21!


def lengths(spark, sf):
    """Masked edges with their tract length."""
    return materialize(fx.edges(spark, sf).where("mask").select(
        "u", "v", F.col("tract").alias("x")))


def weights(spark, sf):
    """Masked edges with a weight in (0, 1): the share of all masked shipments."""
    e = materialize(fx.edges(spark, sf).where("mask").select("u", "v", "w"))
    total = e.agg(F.sum("w").alias("s")).first()["s"]
    return materialize(e.select("u", "v", (F.col("w") / F.lit(total)).alias("x")))


HOPS = 12  # edges the oracles relax over; shortest paths of the fixture need fewer


def relax_sql(step: str) -> str:
    """Chain of relaxations over table ``len`` (u, v, x); ``best`` has dist, hops, nodes."""
    key = "{'d': round(dist, 9), 'h': hops, 'n': nodes}"
    pick = f"arg_min({{'dist': dist, 'hops': hops, 'nodes': nodes}}, {key}) b"
    out = [f"r1 as (select u, v, {step.format(x='x')} dist, 1 hops, [u, v] nodes from len)"]
    for k in range(2, HOPS + 1):
        out.append(
            f"r{k} as (select u, v, unnest(b) from (select u, v, {pick} from ("
            f"select u, v, dist, hops, nodes from r{k-1} union all "
            f"select s.u, l.v, s.dist + {step.format(x='l.x')}, s.hops + 1, list_append(s.nodes, l.v) "
            f"from r{k-1} s join len l on l.u = s.v where s.u <> l.v) group by u, v))")
    return ", ".join(out) + f", best as (select * from r{HOPS})"


SP_SQL = WITH_EDGE + ", len as (select u, v, tract x from edge where mask), " + relax_sql("{x}")


def whole(spark, sf, values, missing, diagonal):
    nodes = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    return M.full_matrix(values, nodes, missing, diagonal).select("u", "v", F.round("x", 6).alias("x"))


def whole_sql(values: str, missing: str, diagonal: str) -> str:
    """Select of every cell of the node matrix from the rows (u, v, x) of ``values``."""
    return f"""
select a.n_nationkey u, b.n_nationkey v,
       case when a.n_nationkey = b.n_nationkey then {diagonal} else coalesce(round(m.x, 6), {missing}) end x
from nation a cross join nation b left join ({values}) m on m.u = a.n_nationkey and m.v = b.n_nationkey"""


@query("routing_efficiency", SP_SQL + whole_sql("select u, v, 1.0 / dist x from best", "0.0::double", "0.0::double"))
def routing_efficiency(spark, sf):
    return whole(spark, sf, M.routing_efficiency(lengths(spark, sf)), 0.0, 0.0)


WEIGHT_SQL = WITH_EDGE + """,
wt as (select u, v, w::double / (select sum(w) from edge where mask) x from edge where mask),
tr as (select u, v, x / sum(x) over (partition by u) p from wt),
len as (select * from wt), """ + relax_sql("(-ln({x}))")


@query("search_information", WEIGHT_SQL + """,
hop as (select u src, v dst, unnest(nodes[1:-2]) a, unnest(nodes[2:]) b from best)""" + whole_sql(
    "select src u, dst v, sum(-log2(p)) x from hop join tr on tr.u = a and tr.v = b group by src, dst",
    "'inf'::double", "null"))
def search_information(spark, sf):
    return whole(spark, sf, M.search_information(weights(spark, sf)), float("inf"), None)


@query("navigation", "with recursive " + fx.EDGE_SQL + """,
len as (select u, v, tract x from edge where mask),
dist as (select u, v, lat d from edge union all select distinct u, u, 0.0::double from edge),
nxt as (select l.u cur, t.u t, arg_min({'n': l.v, 'len': l.x}, {'d': t.d, 'n': l.v}) b
        from len l join dist t on t.v = l.v group by all),
walk as (
  select cur u, t, cur, cur last, 0.0::double len, 0 hops from nxt where cur <> t
  union all
  select w.u, w.t, b.n, w.cur, w.len + b.len, hops + 1
  from walk w join nxt using (cur, t) where w.cur <> w.t and b.n <> w.last and hops < 360)""" + whole_sql(
    "select u, t v, 1.0 / len x from walk where cur = t", "0.0::double", "0.0::double"))
def navigation(spark, sf):
    e = fx.edges(spark, sf)
    d = e.select("u", "v", F.col("lat").alias("x"))
    own = e.select("u").distinct().select("u", F.col("u").alias("v"), F.lit(0.0).alias("x"))
    return whole(spark, sf, M.navigation_efficiency(lengths(spark, sf), d.unionByName(own)), 0.0, 0.0)


def _power_sql() -> str:
    out = ["p1 as (select u, v, x / sqrt(su * coalesce(sv, 1.0)) x from wt "
           "join (select u k, sum(x) su from wt group by 1) a on a.k = u "
           "left join (select u k, sum(x) sv from wt group by 1) b on b.k = v)"]
    for k in range(2, TERMS + 1):
        out.append(f"p{k} as (select a.u, b.v, sum(a.x * b.x) x from p{k-1} a "
                   f"join p1 b on a.v = b.u group by all)")
    return ", ".join(out)




@query("communicability", WITH_EDGE + """,
wt as (select u, v, w::double / (select sum(w) from edge where mask) x from edge where mask), """
       + _power_sql() + ", al as (select n_nationkey u, n_nationkey v, 1.0 x from nation union all "
       "select a.n_nationkey, b.n_nationkey, 0.0 from nation a, nation b" + "".join(f" union all select u, v, x / {math.factorial(k)}.0 from p{k}"
                            for k in range(1, TERMS + 1))
       + ") select u, v, round(sum(x), 6) x from al group by u, v")
def communicability(spark, sf):
    nodes = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    return M.communicability(weights(spark, sf), TERMS, nodes=nodes).select("u", "v", F.round("x", 6).alias("x"))


@query("density_sweep", WITH_EDGE + """,
q as (select unnest([0.5, 0.75, 0.9]) q),
cut as (select q, (select quantile_cont(w::double, 0.5) from tot) c from q where q = 0.5
  union all select 0.75, (select quantile_cont(w::double, 0.75) from tot)
  union all select 0.9, (select quantile_cont(w::double, 0.9) from tot)),
s as (select q, u, v, x / sum(x) over (partition by q, u) p
      from (select q, u, v, w::double x from tot, cut where w >= c))
select round(1 - q, 6) density, count(*)::bigint n, round(sum(p), 6) row_mass, round(max(p), 6) max_p
from s group by q""")
def density_sweep(spark, sf):
    e = materialize(fx.edge_totals(spark, sf).select("u", "v", F.col("w").cast("double").alias("x")))
    s = M.density_sweep(e, [0.5, 0.75, 0.9], M.transition_matrix)
    return s.groupBy(F.round("density", 6).alias("density")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 6).alias("row_mass"),
        F.round(F.max("p"), 6).alias("max_p"))


# ---- signals: events of a user are a channel, event types are trials ---------------

BASE, RESP, THRESH = (0, 864000), (864001, 2700000), 5.0


def seconds_since(ts: str, day: str):
    """Whole seconds since midnight of ``day``, independent of the session time zone."""
    return (F.datediff(ts, F.lit(day).cast("date")).cast("bigint") * 86400 + F.hour(ts) * 3600
            + F.minute(ts) * 60 + F.second(ts))


def event_signal(spark, sf):
    ev = fx.table(spark, sf, "events")
    return ev.select(
        F.col("user_id").alias("channel"), F.col("event_type").alias("trial"),
        seconds_since("ts", "2024-01-01").alias("t"),
        "value", "event_id")


SIG_SQL = """with sig as (
  select user_id channel, event_type trial, value, event_id,
         (floor(epoch(ts)) - epoch(timestamp '2024-01-01 00:00:00'))::bigint t from events),
base as (select channel, trial, avg(value) m, stddev_pop(value) s from sig
         where t between 0 and 864000 group by all),
z as (select sig.*, case when s > 0 then (value - m) / s else 0 end z
      from sig left join base using (channel, trial))"""

DET_SQL = SIG_SQL + """,
resp as (select * from z where t between 864001 and 2700000),
ons as (select channel, trial, min(t) filter (abs(z) > 5.0) onset,
               arg_max({'t': t, 'z': z}, {'a': abs(z), 'nt': -t}) pk from resp group by all),
det as (select k.channel, k.trial, onset, case when onset is not null then pk.t end peak,
               case when onset is not null then pk.z end amp, onset is not null sig
        from (select distinct channel, trial from sig) k left join ons using (channel, trial))"""


@query("baseline_zscore", SIG_SQL + "select event_id, round(z, 6) z from z")
def baseline_zscore(spark, sf):
    return Sg.baseline_zscore(event_signal(spark, sf), ["channel", "trial"], BASE).select(
        "event_id", F.round("z", 6).alias("z"))


def detected(spark, sf):
    return Sg.detect_events(event_signal(spark, sf), ["channel", "trial"], BASE, RESP, THRESH)


@query("onset_peak", DET_SQL + """
select channel, trial, onset, peak, round(amp, 6) peak_amplitude, sig significant from det""")
def onset_peak(spark, sf):
    return detected(spark, sf).withColumn("peak_amplitude", F.round("peak_amplitude", 6))


@query("response_matrix", DET_SQL + """
select trial stim, channel % 25 observed, count(*)::bigint n_trials,
  count(*) filter (sig)::bigint n_onset, quantile_cont(onset, 0.5)::double median_onset,
  count(*) filter (sig)::double / count(*) probability
from det group by all""")
def response_matrix(spark, sf):
    d = detected(spark, sf).select(F.col("trial").alias("stim"),
                                   (F.col("channel") % 25).alias("observed"), "onset", "significant")
    return Sg.response_matrix(d, "stim", "observed").withColumn(
        "median_onset", F.col("median_onset").cast("double"))


@query("response_matrix_text", DET_SQL + """,
m as (select trial stim, channel % 5 observed,
        count(*) filter (sig)::double / count(*) p from det group by all)
select stim, string_agg(printf('%.6f', p), ' ' order by observed) line from m group by stim""")
def response_matrix_text(spark, sf):
    from pathloom.sources.sinks import matrix_lines

    d = detected(spark, sf).groupBy(F.col("trial").alias("stim"),
                                    (F.col("channel") % 5).alias("observed")).agg(
        (F.count_if("significant") / F.count(F.lit(1))).alias("p"))
    return matrix_lines(d, "stim", "observed", "p", list(range(5)))


@query("stimulated_electrode", """
with el as (select user_id subject, event_id ord, event_type electrode,
              regexp_extract(props, '(\\d+)', 1)::int % 40 run from events)
select subject, 7 want_run, arg_min(electrode, {'o': run <> 7, 'i': ord}) electrode,
       bool_or(run = 7) exact_run from el group by subject""")
def stimulated_electrode(spark, sf):
    ev = fx.table(spark, sf, "events")
    el = ev.select(F.col("user_id").alias("subject"), F.col("event_id").alias("ord"),
                   F.col("event_type").alias("electrode"),
                   (F.regexp_extract("props", r"(\d+)", 1).cast("int") % 40).alias("run_number"))
    req = el.select("subject").distinct().withColumn("want_run", F.lit(7))
    return Sg.stimulated_electrode(el, req)


@query("mapping_fallback", """
with w as (select distinct user_id subject, regexp_extract(props, '(\\d+)', 1)::int % 4 run
           from events),
src as (select user_id subject, regexp_extract(props, '(\\d+)', 1)::int % 4 run, max(event_id) file
        from events where event_type = 'click' and value > 20 group by all)
select w.subject, w.run, coalesce(a.file, b.file) file
from w left join src a on a.subject = w.subject and a.run = w.run
left join src b on b.subject = w.subject and b.run = 1
where coalesce(a.file, b.file) is not null""")
def mapping_fallback(spark, sf):
    ev = fx.table(spark, sf, "events").select(
        F.col("user_id").alias("subject"), "event_id", "event_type", "value",
        (F.regexp_extract("props", r"(\d+)", 1).cast("int") % 4).alias("run"))
    want = ev.select("subject", "run").distinct()
    src = ev.where("event_type = 'click' and value > 20").groupBy("subject", "run").agg(
        F.max("event_id").alias("file"))
    return Sg.with_fallback(want, src, "subject", "run", "file")


# ---- geometry: vectors are points, labels are parcels ---------------------------------


def points(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("v"), F.col("label"), *[
        F.element_at("embedding", i + 1).cast("double").alias(a) for i, a in enumerate("xyz")])


MESH_SQL = """with pt as (select vec_id v, label, embedding[1]::double x, embedding[2]::double y,
                 embedding[3]::double z from embeddings),
fc as (select a.v v0, b.v v1, c.v v2,
   [b.x - a.x, b.y - a.y, b.z - a.z] e, [c.x - a.x, c.y - a.y, c.z - a.z] f
   from pt a join pt b on b.v = a.v + 1 join pt c on c.v = a.v + 2),
fa as (select v0, v1, v2, sqrt((e[2]*f[3]-e[3]*f[2])^2 + (e[3]*f[1]-e[1]*f[3])^2
       + (e[1]*f[2]-e[2]*f[1])^2) / 2 area from fc),
va as (select v, sum(area / 3) area from (select unnest([v0, v1, v2]) v, area from fa) group by v)"""


def mesh(spark, sf):
    p = points(spark, sf)
    f = p.select(F.col("v").alias("v0"), (F.col("v") + 1).alias("v1"), (F.col("v") + 2).alias("v2"))
    return p, f


@query("vertex_area", MESH_SQL + "select v, round(area, 6) area from va")
def vertex_area(spark, sf):
    p, f = mesh(spark, sf)
    return Geo.vertex_areas(p, f).select("v", F.round("area", 6).alias("area"))


CENT_SQL = MESH_SQL + """,
ce as (select label, sum(area) area, count(*)::bigint n, sum(area * x) / sum(area) x,
         sum(area * y) / sum(area) y, sum(area * z) / sum(area) z
       from pt join va using (v) group by label)"""


def centroids(spark, sf):
    p, f = mesh(spark, sf)
    return Geo.parcel_centroids(p, Geo.vertex_areas(p, f))


@query("weighted_centroid", CENT_SQL + """
select label, round(area, 6) area, n n_vertices, round(x, 6) x, round(y, 6) y, round(z, 6) z from ce""")
def weighted_centroid(spark, sf):
    c = centroids(spark, sf)
    return c.select("label", "n_vertices", *[F.round(a, 6).alias(a) for a in ("area", *"xyz")])


NEAR_SQL = CENT_SQL + """,
nr as (select v, arg_min(c.label, {'d': sqrt((p.x-c.x)^2 + (p.y-c.y)^2 + (p.z-c.z)^2), 'o': c.label})
         parcel, min(sqrt((p.x-c.x)^2 + (p.y-c.y)^2 + (p.z-c.z)^2)) dist
       from pt p, ce c group by v)"""


def assigned(spark, sf, limit=Geo.CENTROID_LIMIT):
    c = materialize(centroids(spark, sf)).withColumn("ord", F.col("label")).withColumnRenamed(
        "label", "parcel")
    p = points(spark, sf).select("v", "x", "y", "z")
    return Geo.nearest(p, c, "v", "parcel", limit), c


@query("nearest_centroid", NEAR_SQL + "select v, parcel, round(dist, 6) dist from nr")
def nearest_centroid(spark, sf):
    return assigned(spark, sf)[0].select("v", "parcel", F.round("dist", 6).alias("dist"))


@query("nearest_centroid_grid", NEAR_SQL + "select v, parcel, round(dist, 6) dist from nr")
def nearest_centroid_grid(spark, sf):
    return assigned(spark, sf, limit=0)[0].select("v", "parcel", F.round("dist", 6).alias("dist"))


@query("active_parcels", NEAR_SQL + """
select parcel, round(area, 6) area, round(x, 6) x, round(y, 6) y, round(z, 6) z,
       count(*)::bigint n_electrodes
from nr join ce on ce.label = parcel group by all""")
def active_parcels(spark, sf):
    a, c = assigned(spark, sf)
    return Geo.active_parcels(a, c, "parcel").select(
        "parcel", "n_electrodes", *[F.round(k, 6).alias(k) for k in ("area", *"xyz")])


@query("signal_parcel_mean", NEAR_SQL + """
select parcel, event_type trial, floor(epoch(ts) / 86400)::bigint as day, avg(round(value * 100)) as value,
       count(distinct user_id)::bigint n_electrodes
from events join nr on nr.v = user_id where event_type <> 'error' group by all""")
def signal_parcel_mean(spark, sf):
    a, _ = assigned(spark, sf)
    ev = fx.table(spark, sf, "events").select(
        F.col("user_id").alias("electrode"), F.col("event_type").alias("trial"),
        F.datediff("ts", F.lit("1970-01-01").cast("date")).cast("bigint").alias("day"), F.round(F.col("value") * 100).alias("value"),
        F.when(F.col("event_type") == "error", "bad").otherwise("GOOD").alias("status"))
    return Sg.parcel_signal(ev, a.withColumnRenamed("v", "electrode"), ["trial", "day"])


AFFINE = [[1.0, 0.0, 0.0, 2.0], [0.0, -1.0, 0.0, 0.5], [0.0, 0.0, 2.0, 0.0]]
INVERSE = [[1.0, 0.0, 0.0, -2.0], [0.0, -1.0, 0.0, 0.5], [0.0, 0.0, 0.5, 0.0]]


@query("affine_points", """
select vec_id v, round(embedding[1]::double + 2, 9) ax, round(0.5 - embedding[2]::double, 9) ay,
  round(2 * embedding[3]::double, 9) az, true restored from embeddings""")
def affine_points(spark, sf):
    from pathloom.functions.columns import affine

    x, y, z = (F.col(a) for a in "xyz")
    moved = affine(AFFINE, x, y, z)
    back = affine(INVERSE, *moved)
    same = F.lit(True)
    for a, b in zip((x, y, z), back):
        same = same & (F.abs(a - b) < 1e-9)
    return points(spark, sf).select("v", *[F.round(c, 9).alias(n) for c, n in
                                           zip(moved, ("ax", "ay", "az"))], same.alias("restored"))
