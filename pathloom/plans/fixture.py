"""Graph and prediction frames derived from the star-schema tables.

Nodes are nations; the edge (supplier nation -> customer nation) carries
aggregates of the lineitems shipped along it.  Money, discounts and tax are
summed as whole hundredths, so results do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.session import broadcast_if_small, materialize

METRICS = ("nav", "rout", "search", "comm")
MASK_QUANTILE = 0.75
MAX_LEN = 20  # fixed value: the longest path that is looked for
REPEATS, FOLDS = 5, 5  # fixed values: the protocol of the cross-validations


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hundredths(c) -> F.Column:
    return F.round(F.col(c) * 100).cast("bigint")


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """One row per lineitem with both nations and the delay in days."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    # nation keys reach the orders first: that join is a third of lineitem's size
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("v"))
    supp = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("u"))
    placed = orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        "o_orderkey", "v", "o_orderdate")
    return (
        li.join(supp, li.l_suppkey == supp.s_suppkey)
        .join(placed, li.l_orderkey == placed.o_orderkey)
        .where(F.col("u") != F.col("v"))
        .select("u", "v", "l_orderkey", "l_linenumber",
                F.abs(F.datediff("l_shipdate", "o_orderdate")).alias("lag"),
                F.col("l_quantity").cast("bigint").alias("qty"),
                hundredths("l_extendedprice").alias("cents"),
                hundredths("l_discount").alias("disc"),
                hundredths("l_tax").alias("tax"),
                (F.col("l_returnflag") == "R").cast("int").alias("ret"))
    )


def edge_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Exact totals per nation pair, one row per observed pair."""
    # first by (u, v, lag): a hash aggregation with map-side combine that leaves
    # at most one row per day of delay, whatever the weight of one pair
    by_lag = shipments(spark, sf).groupBy("u", "v", "lag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.sum("cents").alias("w"),
        F.sum("disc").alias("disc"), F.sum("tax").alias("tax"), F.sum("ret").alias("ret"))
    return by_lag.groupBy("u", "v").agg(
        F.sum("n").alias("n"), F.sum("qty").alias("qty"), F.sum("w").alias("w"),
        F.sum("disc").alias("disc"), F.sum("tax").alias("tax"), F.sum("ret").alias("ret"),
        F.percentile("lag", 0.5, F.col("n")).cast("double").alias("lat"))


def with_metrics(tot: DataFrame) -> DataFrame:
    n = F.col("n")
    return tot.select(
        "u", "v", "n", "w", "lat",
        (F.col("ret") / n).alias("y"),
        (F.col("w") / n / 10000.0).alias("tract"),
        (F.col("qty") / n).alias("nav"), (F.col("disc") / n).alias("rout"),
        (F.col("tax") / n).alias("search"), (F.col("ret") * 20.0 / n).alias("comm"))


def edges(spark: SparkSession, sf: str, q: float = MASK_QUANTILE) -> DataFrame:
    """Edge table with the structural mask, written once for all later branches."""
    from pathloom.operators.graph import density_mask

    base = materialize(with_metrics(edge_totals(spark, sf)))
    return density_mask(base, "w", q)


def dag(spark: SparkSession, sf: str, q: float = MASK_QUANTILE) -> tuple[DataFrame, DataFrame]:
    """(edges, seed DAG) of the fixture graph."""
    from pathloom.operators.graph import onset_table, seed_dag

    e = edges(spark, sf, q)
    return e, materialize(seed_dag(onset_table(e), e))


def paths(spark: SparkSession, sf: str, max_len: int = MAX_LEN) -> DataFrame:
    """All DAG paths up to ``max_len`` edges with the attributes of their edges."""
    from pathloom.operators.graph import enumerate_paths

    _, d = dag(spark, sf)
    return enumerate_paths(d, max_len)


def nation_region(spark: SparkSession, sf: str) -> DataFrame:
    return broadcast_if_small(
        table(spark, sf, "nation").select(
            F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("network"),
            "n_name"))


# ---- the same frames for the SQL oracle -------------------------------------

SHIP_SQL = """
ship as (
  select s_nationkey u, c_nationkey v, l_orderkey, l_linenumber,
         abs(date_diff('day', o_orderdate::date, l_shipdate::date)) lag,
         l_quantity::bigint qty, round(l_extendedprice*100)::bigint cents,
         round(l_discount*100)::bigint disc, round(l_tax*100)::bigint tax,
         (l_returnflag = 'R')::int ret
  from lineitem join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  where s_nationkey <> c_nationkey)"""

EDGE_SQL = SHIP_SQL + """,
tot as (
  select u, v, count(*)::bigint n, sum(qty)::bigint qty, sum(cents)::bigint w,
         sum(disc)::bigint disc, sum(tax)::bigint tax, sum(ret)::bigint ret,
         quantile_cont(lag, 0.5)::double lat
  from ship group by u, v),
edge as (
  select u, v, n, w, lat, ret::double / n y, w::double / n / 10000.0 tract,
         qty::double / n nav, disc::double / n rout, tax::double / n search,
         ret * 20.0::double / n comm,
         w >= (select quantile_cont(w::double, 0.75) from tot) mask
  from tot)"""

DAG_SQL = EDGE_SQL + """,
onset as (
  select u seed, v node, lat from edge where lat > 0
  union all select u, u, 0.0::double from (select distinct u from edge)),
dag as (
  select a.seed, e.u, e.v, a.lat lat_u, b.lat lat_v, e.w, e.tract, e.nav, e.rout,
         e.search, e.comm
  from onset a join edge e on e.u = a.node and e.mask
  join onset b on b.seed = a.seed and b.node = e.v
  where b.lat > a.lat)"""

PATH_SQL = DAG_SQL + f""",
walk as (
  select seed, v node, 1 L, [u, v] nodes, [lat_u, lat_v] lat, [w] w, [tract] tract,
         [nav] nav, [rout] rout, [search] search, [comm] comm
  from dag where u = seed
  union all
  select k.seed, d.v, k.L + 1, list_append(k.nodes, d.v), list_append(k.lat, d.lat_v),
         list_append(k.w, d.w), list_append(k.tract, d.tract), list_append(k.nav, d.nav),
         list_append(k.rout, d.rout), list_append(k.search, d.search),
         list_append(k.comm, d.comm)
  from walk k join dag d on d.seed = k.seed and d.u = k.node
  where k.L < {MAX_LEN}),
path as (
  select *, node endpoint, seed || '|' || node || '|' || L sample_id,
         array_to_string(nodes, '|') path_key from walk)"""

WITH_EDGE = "with " + EDGE_SQL
WITH_DAG = "with " + DAG_SQL
WITH_PATH = "with recursive " + PATH_SQL
