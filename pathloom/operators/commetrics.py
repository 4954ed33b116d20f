"""Communication metrics of a weighted graph as iterated joins.

Matrices are long tables (u, v, x).  Every loop carries one row per node pair at
most and is cut by reliable checkpoints.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.columns import finite
from pathloom.session import broadcast_if_small, materialize


def matrix_audit(matrix: DataFrame, metrics: list[str], n_nodes: int) -> DataFrame:
    """Finite and missing counts, range and percentiles per metric.

    The matrix is stacked, so each metric is one group of at most n^2 cells.
    """
    long = matrix.select("u", "v", F.explode(F.create_map(*[
        c for m in metrics for c in (F.lit(m), F.col(m))])).alias("metric", "x"))
    ok = finite("x")
    x = F.when(ok, F.col("x"))
    q = F.percentile(x, F.array(F.lit(0.05), F.lit(0.95)))
    return long.groupBy("metric").agg(
        F.count_if(ok).alias("n_finite"),
        (F.lit(n_nodes * n_nodes) - F.count_if(ok)).alias("n_missing"),
        F.round(F.min(x), 6).alias("min_x"), F.round(F.max(x), 6).alias("max_x"),
        F.round(q[0], 6).alias("p05"), F.round(q[1], 6).alias("p95"),
        F.count_if(F.col("u") == F.col("v")).alias("n_diagonal"))


def compare_matrices(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest difference over jointly finite cells, and one-sided cells."""
    l = a.where(finite("x")).select("u", "v", F.col("x").alias("xa"))
    r = b.where(finite("x")).select("u", "v", F.col("x").alias("xb"))
    j = l.join(r, ["u", "v"], "full")
    return j.agg(
        F.count_if(F.col("xa").isNotNull() & F.col("xb").isNotNull()).alias("n_joint"),
        F.max(F.abs(F.col("xa") - F.col("xb"))).alias("max_abs_diff"),
        F.count_if(F.col("xb").isNull()).alias("n_left_only"),
        F.count_if(F.col("xa").isNull()).alias("n_right_only"))


def shortest_paths(lengths: DataFrame, transform: str | None = None, max_rounds: int = 64
                   ) -> DataFrame:
    """(u, v, dist, hops, nodes) of the shortest path of every connected pair.

    ``lengths`` holds (u, v, x) with x > 0.  ``transform='log'`` turns weights in
    (0, 1] into -ln(x).  Doubling min-plus joins: round k knows all paths of up to
    2^k edges, so the loop ends after log2(diameter) rounds.
    Ties: fewer hops, then the smallest node array.
    """
    x = -F.log("x") if transform == "log" else F.col("x")
    cur = materialize(lengths.where("u <> v and x > 0").groupBy("u", "v").agg(
        F.min(F.struct(x.cast("double").alias("dist"), F.lit(1).alias("hops"),
                       F.array("u", "v").alias("nodes"))).alias("b")).select("u", "v", "b.*"))
    before = None
    for _ in range(max_rounds):
        a = cur.select("u", F.col("v").alias("m"), "dist", "hops", "nodes")
        b = cur.select(F.col("u").alias("m"), "v", F.col("dist").alias("d2"),
                       F.col("hops").alias("h2"), F.col("nodes").alias("n2"))
        longer = a.join(b, "m").where("u <> v").select(
            "u", "v", F.round(F.col("dist") + F.col("d2"), 12).alias("dist"),
            (F.col("hops") + F.col("h2")).alias("hops"),
            F.concat("nodes", F.slice("n2", 2, F.size("n2"))).alias("nodes"))
        best = cur.withColumn("dist", F.round("dist", 12)).unionByName(longer).groupBy(
            "u", "v").agg(F.min(F.struct("dist", "hops", "nodes")).alias("b"))
        cur = materialize(best.select("u", "v", "b.*"))
        state = cur.agg(F.count(F.lit(1)), F.sum("hops"), F.sum("dist")).first()
        if before == tuple(state):
            break
        before = tuple(state)
    return cur


def full_matrix(values: DataFrame, nodes: DataFrame, missing: float, diagonal: float | None
                ) -> DataFrame:
    """(u, v, x) for every pair of ``nodes`` (node): the whole matrix is the result here."""
    every = nodes.select(F.col("node").alias("u")).distinct()
    grid = every.crossJoin(every.withColumnRenamed("u", "v"))
    x = F.when(F.col("u") == F.col("v"), F.lit(diagonal)).otherwise(F.coalesce("x", F.lit(missing)))
    return grid.join(values.select("u", "v", "x"), ["u", "v"], "left").select("u", "v", x.cast("double").alias("x"))


def whole_matrix(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """``values`` with zeros for the pairs of ``nodes`` (node) that it lacks, the diagonal as it is."""
    every = nodes.select(F.col("node").alias("u")).distinct()
    zeros = every.crossJoin(every.withColumnRenamed("u", "v")).withColumn("x", F.lit(0.0))
    return zeros.unionByName(values.select("u", "v", "x")).groupBy("u", "v").agg(F.sum("x").alias("x"))


def routing_efficiency(lengths: DataFrame) -> DataFrame:
    """1 / shortest distance of connected pairs; ``full_matrix`` adds the zeros."""
    return shortest_paths(lengths).select("u", "v", (1.0 / F.col("dist")).alias("x"))


def transition_matrix(weights: DataFrame) -> DataFrame:
    total = weights.groupBy("u").agg(F.sum("x").alias("s"))
    return weights.join(total, "u").select("u", "v", (F.col("x") / F.col("s")).alias("p"))


def search_information(weights: DataFrame, symmetric: bool = False) -> DataFrame:
    """-log2 of the probability to follow the shortest path (log-transformed weights) of
    connected pairs; ``full_matrix`` adds infinity for the others (0 for symmetric input).

    Symmetric input measures the path of (u < v) in both directions.
    """
    t = broadcast_if_small(materialize(transition_matrix(weights)))
    sp = shortest_paths(weights, "log")
    if symmetric:
        up = sp.where("u < v").select("u", "v", "nodes")
        sp = up.unionByName(up.select(
            F.col("v").alias("u"), F.col("u").alias("v"), F.reverse("nodes").alias("nodes")))
    n = F.size("nodes")
    hop = sp.select(
        F.col("u").alias("src"), F.col("v").alias("dst"),
        F.explode(F.arrays_zip(F.slice("nodes", 1, n - 1).alias("u"),
                               F.slice("nodes", 2, n - 1).alias("v"))).alias("e")).select(
        "src", "dst", F.col("e.u").alias("u"), F.col("e.v").alias("v"))
    return hop.join(t, ["u", "v"], "left").groupBy("src", "dst").agg(
        F.sum(-F.log2("p")).alias("x")).select(
        F.col("src").alias("u"), F.col("dst").alias("v"), "x")


def navigation_efficiency(lengths: DataFrame, distances: DataFrame, max_hops: int = 360
                          ) -> DataFrame:
    """Greedy walks to the neighbour nearest the target, as 1 / walked length.

    A walk fails when it turns straight back or exceeds ``max_hops``; failed walks
    have no row here, ``full_matrix`` adds their zeros.  The next hop depends on (node, target) only, so
    it is tabled once; all walks then advance together, one join per hop.
    """
    nb = lengths.where("x <> 0").select("u", F.col("v").alias("n"), F.col("x").alias("len"))
    to = distances.select(F.col("u").alias("t"), F.col("v").alias("n"), F.col("x").alias("d"))
    # per (node, target): the neighbour with the least distance, the smallest id first
    nxt = nb.join(to, "n").groupBy("u", "t").agg(
        F.min(F.struct("d", "n", "len")).alias("b")).select(
        F.col("u").alias("at"), "t", F.col("b.n").alias("n"), F.col("b.len").alias("len"))
    nxt = broadcast_if_small(materialize(nxt))
    cur = nxt.where("at <> t").select(
        F.col("at").alias("u"), "t", "at", F.col("at").alias("last"), F.lit(0.0).alias("len_sum"))
    arrived = None
    for hop in range(max_hops):
        moved = materialize(
            cur.join(nxt, ["at", "t"]).where("n <> last")
            .select("u", "t", F.col("n").alias("at"), F.col("at").alias("last"),
                    (F.col("len_sum") + F.col("len")).alias("len_sum")))
        done = moved.where("at = t").select("u", F.col("t").alias("v"), "len_sum")
        arrived = done if arrived is None else arrived.unionByName(done)
        cur = moved.where("at <> t")
        if cur.isEmpty():
            break
    return arrived.select("u", "v", F.when(F.col("len_sum") > 0, 1.0 / F.col("len_sum"))
                          .otherwise(0.0).alias("x"))


def normalised_strength(weights: DataFrame) -> DataFrame:
    """w / sqrt(s_u s_v) with row strengths s; a zero strength counts as 1."""
    s = weights.groupBy("u").agg(F.sum("x").alias("s"))
    safe = s.select(F.col("u").alias("k"), F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
                    .alias("s"))
    a = safe.select(F.col("k").alias("u"), F.col("s").alias("su"))
    b = safe.select(F.col("k").alias("v"), F.col("s").alias("sv"))
    return (weights.join(a, "u").join(b, "v", "left")
            .select("u", "v", (F.col("x") / F.sqrt(F.col("su") * F.coalesce("sv", F.lit(1.0))))
                    .alias("x")))


def communicability(weights: DataFrame, terms: int = 20, cut_every: int = 4, nodes: DataFrame | None = None) -> DataFrame:
    """exp of the strength-normalised matrix as a Taylor sum of sparse products: the cells that
    walks reach, or with ``nodes`` (node) the whole matrix, where a node without edges has one
    on the diagonal."""
    w = materialize(normalised_strength(weights))
    all_nodes = nodes
    nodes = w.select("u").union(w.select("v")).distinct() if nodes is None else nodes.select(F.col("node").alias("u")).distinct()
    right = broadcast_if_small(w.select(F.col("u").alias("m"), F.col("v").alias("v2"),
                                        F.col("x").alias("y")))
    total = nodes.select("u", F.col("u").alias("v"), F.lit(1.0).alias("x"))
    power = w
    total = total.unionByName(power)
    for k in range(2, terms + 1):
        power = (power.select("u", F.col("v").alias("m"), "x").join(right, "m")
                 .groupBy("u", F.col("v2").alias("v")).agg(F.sum(F.col("x") * F.col("y")).alias("x")))
        if k % cut_every == 0:
            power = materialize(power)
        total = total.unionByName(power.select("u", "v", (F.col("x") / float(math.factorial(k))).alias("x")))
    out = total.groupBy("u", "v").agg(F.sum("x").alias("x"))
    return out if all_nodes is None else whole_matrix(out, all_nodes)


def density_sweep(weights: DataFrame, quantiles: list[float], measure) -> DataFrame:
    """One metric per density: keep the edges above each weight quantile, measure, union."""
    cuts = weights.agg(F.percentile("x", F.array(*[F.lit(q) for q in quantiles])).alias("c")
                       ).first()["c"]  # at most nodes^2 edges
    out = None
    for q, c in zip(quantiles, cuts):
        part = measure(weights.where(F.col("x") >= F.lit(c))).withColumn("density", F.lit(1 - q))
        out = part if out is None else out.unionByName(part)
    return out


def floyd_reference(n: int, rows: list[tuple[int, int, float]]) -> list[list[float]]:
    """Plain all-pairs distances of a tiny graph, for tests."""
    d = [[0.0 if i == j else math.inf for j in range(n)] for i in range(n)]
    for u, v, x in rows:
        d[u][v] = min(d[u][v], x)
    for k in range(n):
        for i in range(n):
            for j in range(n):
                d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    return d
