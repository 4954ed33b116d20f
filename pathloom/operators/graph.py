"""Latency DAGs and the paths in them: counting, ranking, sampling, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.columns import arr_mean, arr_sum, hash_hex, hash_int, hash_mod, level_key
from pathloom.session import broadcast_if_small, materialize

EDGE_ATTRS = ["w", "tract", "nav", "rout", "search", "comm"]
CELL = ["seed", "endpoint", "L"]


def density_mask(edges: DataFrame, weight: str, q: float) -> DataFrame:
    """Keep the heaviest edges: ``mask`` is true from the q-quantile upward.

    The edge table has at most nodes^2 rows, so one exact percentile suffices.
    """
    cut = edges.agg(F.percentile(F.col(weight).cast("double"), q).alias("c")).first()["c"]
    return edges.withColumn("mask", F.col(weight) >= F.lit(cut))


def onset_table(edges: DataFrame, latency: str = "lat") -> DataFrame:
    """(seed, node, lat): positive latencies, and the seed itself at zero."""
    seen = edges.where(F.col(latency) > 0).select(
        F.col("u").alias("seed"), F.col("v").alias("node"), F.col(latency).alias("lat"))
    own = edges.select(F.col("u").alias("seed")).distinct().select(
        "seed", F.col("seed").alias("node"), F.lit(0.0).alias("lat"))
    return seen.unionByName(own)


def symmetric_mask(edges: DataFrame) -> DataFrame:
    """Mask an edge when it or its reverse is masked."""
    back = edges.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("mask").alias("back"))
    return edges.join(back, ["u", "v"], "left").withColumn(
        "mask", F.col("mask") | F.coalesce("back", F.lit(False))).drop("back")


def seed_dag(onset: DataFrame, edges: DataFrame, half: int | None = None) -> DataFrame:
    """Edges usable from every seed: masked, and strictly later at the head.

    Both joins are equi-joins, the latency comparison is a residual.  With
    ``half`` the graph stays inside the half (id below / not below) of its seed.
    """
    attrs = [c for c in EDGE_ATTRS if c in edges.columns]
    e = broadcast_if_small(edges.where("mask").select("u", "v", *attrs))
    a = onset.select("seed", F.col("node").alias("u"), F.col("lat").alias("lat_u"))
    b = onset.select("seed", F.col("node").alias("v"), F.col("lat").alias("lat_v"))
    d = a.join(e, "u").join(b, ["seed", "v"]).where(F.col("lat_v") > F.col("lat_u"))
    if half is not None:
        side = F.col("seed") < half
        d = d.where(((F.col("u") < half) == side) & ((F.col("v") < half) == side))
    return d.select("seed", "u", "v", "lat_u", "lat_v", *attrs)


def count_paths(dag: DataFrame, max_len: int, cut_every: int = 4) -> DataFrame:
    """(seed, endpoint, L, cnt): exact path counts, one forward pass per length."""
    step = broadcast_if_small(dag.select("seed", F.col("u").alias("at"), "v"))
    cur = dag.where("u = seed").groupBy("seed", F.col("v").alias("at")).agg(
        F.count(F.lit(1)).alias("cnt"))
    out = None
    for L in range(1, max_len + 1):
        if L > 1:
            cur = (cur.join(step, ["seed", "at"]).groupBy("seed", F.col("v").alias("at"))
                   .agg(F.sum("cnt").alias("cnt")))
        if L % cut_every == 0:
            cur = materialize(cur)
            if cur.isEmpty():
                break
        rows = cur.select("seed", F.col("at").alias("endpoint"), F.lit(L).alias("L"), "cnt")
        out = rows if out is None else out.unionByName(rows)
    return out


def remaining_counts(dag: DataFrame, max_len: int, cut_every: int = 4) -> DataFrame:
    """(seed, endpoint, u, rem, cnt): paths from ``u`` to ``endpoint`` in ``rem`` edges."""
    back = broadcast_if_small(dag.select("seed", "u", F.col("v").alias("at")))
    cur = dag.select("seed", F.col("v").alias("endpoint"), F.col("v").alias("at")).distinct() \
        .withColumn("cnt", F.lit(1).cast("bigint"))
    out = cur.select("seed", "endpoint", F.col("at").alias("u"), F.lit(0).alias("rem"), "cnt")
    for rem in range(1, max_len + 1):
        cur = (cur.join(back, ["seed", "at"]).groupBy("seed", "endpoint", F.col("u").alias("at"))
               .agg(F.sum("cnt").alias("cnt")))
        if rem % cut_every == 0:
            cur = materialize(cur)
            if cur.isEmpty():
                break
        out = out.unionByName(cur.select(
            "seed", "endpoint", F.col("at").alias("u"), F.lit(rem).alias("rem"), "cnt"))
    return out


def child_ranges(dag: DataFrame, rest: DataFrame) -> DataFrame:
    """Rank interval [lo, hi) of every child, children in ascending node id.

    A window group holds the children of one node, at most one per graph node.
    """
    kids = dag.select("seed", "u", "v").join(
        rest.select("seed", "endpoint", F.col("u").alias("v"),
                    (F.col("rem") + 1).alias("rem"), "cnt"), ["seed", "v"])
    w = (Window.partitionBy("seed", "endpoint", "rem", "u").orderBy("v")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return kids.select("seed", "endpoint", "rem", "u", "v",
                       (F.sum("cnt").over(w) - F.col("cnt")).alias("lo"),
                       F.sum("cnt").over(w).alias("hi"))


def _with_child(cur: DataFrame, steps: DataFrame, pick: Column) -> DataFrame:
    """Left join of open paths to the one child that ``pick`` selects."""
    kid = steps.select(*[F.col(c).alias(f"k_{c}") for c in ("seed", "endpoint", "rem", "u")],
                       *[c for c in steps.columns if c not in ("seed", "endpoint", "rem", "u")])
    on = pick
    for c in ("seed", "endpoint", "rem", "u"):
        on = on & (F.col(c) == F.col(f"k_{c}"))
    return cur.join(kid, on, "left")


def unrank(ranks: DataFrame, ranges: DataFrame, max_len: int, cut_every: int = 4) -> DataFrame:
    """Turn (seed, endpoint, L, rank) into node arrays.

    One join per edge on (seed, endpoint, rem, node) with the rank interval as
    residual.  A rank outside [0, total) finds no child: it stays with NULL
    nodes, see :func:`check_ranks`.
    """
    steps = broadcast_if_small(ranges)
    max_len = min(max_len, ranges.agg(F.max("rem")).first()[0] or 0)
    cur = ranks.select(*CELL, "rank", F.col("rank").alias("r"), F.col("L").alias("rem"),
                       F.col("seed").alias("u"),
                       F.array(F.col("seed").cast("int")).alias("nodes"))
    for i in range(max_len):
        # a finished path (rem = 0) finds no child and passes through unchanged
        hit = F.col("hi").isNotNull()
        cur = _with_child(cur, steps, (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
        cur = cur.select(
            *CELL, "rank", F.when(hit, F.col("r") - F.col("lo")).otherwise(F.col("r")).alias("r"),
            F.when(hit, F.col("rem") - 1).otherwise(F.col("rem")).alias("rem"),
            F.when(hit, F.col("v")).otherwise(F.col("u")).alias("u"),
            F.when(hit, F.array_append("nodes", F.col("v").cast("int")))
            .otherwise(F.col("nodes")).alias("nodes"))
        if (i + 1) % cut_every == 0 and i + 1 < max_len:
            cur = materialize(cur)
    return cur.select(*CELL, "rank", F.when(F.col("rem") == 0, F.col("nodes")).alias("nodes"))


def check_ranks(ranks: DataFrame, counts: DataFrame) -> DataFrame:
    """Ranks with their total; a rank outside [0, total) raises when evaluated."""
    joined = ranks.join(counts.select(*CELL, F.col("cnt").alias("total")), CELL, "left")
    ok = (F.col("rank") >= 0) & (F.col("rank") < F.coalesce("total", F.lit(0)))
    # the checked value is the column itself, so the optimizer cannot drop the test
    checked = F.when(ok, F.col("rank")).otherwise(
        F.raise_error(F.lit("rank outside [0, total)")).cast("bigint"))
    return joined.withColumn("rank", checked)


def sample_ranks(counts: DataFrame, k: int, tag: str) -> DataFrame:
    """Uniform ranks without replacement, ``min(k, total)`` per cell.

    Up to 4k paths: all ranks compete and the k smallest hashes win.  Beyond
    that: 4k hashed draws, repeats removed, the first k kept.  Either way a cell
    contributes at most 4k short-lived rows.
    """
    sid = F.concat_ws("|", *CELL)
    small = counts.where(F.col("cnt") <= 4 * k).withColumn(
        "rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cnt") - 1)))
    small = small.select(*CELL, "rank", hash_hex(tag, sid, F.col("rank")).alias("h"))
    large = counts.where(F.col("cnt") > 4 * k).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(4 * k - 1))))
    large = (large.select(*CELL, hash_mod(F.col("cnt"), tag, sid, F.col("j")).alias("rank"), "j")
             .groupBy(*CELL, "rank").agg(F.min("j").alias("j"))
             .select(*CELL, "rank", F.lpad(F.col("j").cast("string"), 12, "0").alias("h")))
    w = Window.partitionBy(*CELL).orderBy("h", "rank")
    return (small.unionByName(large).withColumn("i", F.row_number().over(w))
            .where(F.col("i") <= k).select(*CELL, "rank"))


def sampled_paths(dag: DataFrame, max_len: int, k: int, tag: str) -> DataFrame:
    """The candidate set of every cell: everything when few paths, else a sample."""
    rest = materialize(remaining_counts(dag, max_len))
    totals = rest.where("u = seed and rem > 0").select(
        "seed", "endpoint", F.col("rem").alias("L"), "cnt")
    return unrank(sample_ranks(totals, k, tag), materialize(child_ranges(dag, rest)), max_len)


def random_walks(dag: DataFrame, max_len: int, k: int, tag: str, tries: int = 4) -> DataFrame:
    """Candidates of long cells: walks that pick a reachable child at random.

    ``tries * k`` hashed walks per cell, distinct ones kept, cells left short
    topped up from the rank sample.
    """
    rest = materialize(remaining_counts(dag, max_len))
    cells = rest.where("u = seed and rem > 0").select(
        "seed", "endpoint", F.col("rem").alias("L"), "cnt")
    w = Window.partitionBy("seed", "endpoint", "rem", "u")
    kids = materialize(
        child_ranges(dag, rest)
        .withColumn("i", F.row_number().over(w.orderBy("v")) - 1)
        .withColumn("m", F.count(F.lit(1)).over(w)).drop("lo", "hi"))
    steps = broadcast_if_small(kids)
    sid = F.concat_ws("|", *CELL)
    cur = cells.select(
        *CELL, F.explode(F.sequence(F.lit(0), F.lit(tries * k - 1))).alias("walk"),
        F.col("L").alias("rem"), F.col("seed").alias("u"),
        F.array(F.col("seed").cast("int")).alias("nodes"))
    for i in range(min(max_len, kids.agg(F.max("rem")).first()[0] or 0)):
        hit = F.col("m").isNotNull()
        cur = cur.withColumn("h", hash_int(tag, sid, F.col("walk"), F.col("rem")))
        cur = _with_child(cur, steps, F.col("i") == F.pmod(F.col("h"), F.col("m")))
        cur = cur.select(
            *CELL, "walk", F.when(hit, F.col("rem") - 1).otherwise(F.col("rem")).alias("rem"),
            F.when(hit, F.col("v")).otherwise(F.col("u")).alias("u"),
            F.when(hit, F.array_append("nodes", F.col("v").cast("int")))
            .otherwise(F.col("nodes")).alias("nodes"))
        if (i + 1) % 4 == 0:
            cur = materialize(cur)
    walks = cur.groupBy(*CELL, "nodes").agg(F.min("walk").alias("walk"))
    extra = unrank(sample_ranks(cells, k, tag), child_ranges(dag, rest), max_len).select(
        *CELL, "nodes", (F.col("rank") + tries * k).alias("walk"))
    both = walks.unionByName(extra).groupBy(*CELL, "nodes").agg(F.min("walk").alias("walk"))
    order = Window.partitionBy(*CELL).orderBy("walk", F.array_join("nodes", "|"))
    return (both.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k)
            .select(*CELL, "nodes"))


def candidates(dag: DataFrame, max_len: int, k: int, tag: str, walk_above: int = 10
               ) -> DataFrame:
    """Full listing or rank sample up to ``walk_above`` edges, random walks beyond."""
    short = sampled_paths(dag, min(max_len, walk_above), k, tag).select(*CELL, "nodes")
    if max_len <= walk_above:
        return short
    return short.unionByName(
        random_walks(dag, max_len, k, tag).where(F.col("L") > walk_above))


def enumerate_paths(dag: DataFrame, max_len: int, cut_every: int = 3) -> DataFrame:
    """Every path up to ``max_len`` edges with latencies and edge attributes.

    Attributes travel with the path as arrays, so screens and features need no
    further join or shuffle.
    """
    attrs = [c for c in EDGE_ATTRS if c in dag.columns]
    hop = broadcast_if_small(dag.select(
        "seed", F.col("u").alias("at"), "v", F.col("lat_v").alias("x_lat"),
        *[F.col(a).alias(f"x_{a}") for a in attrs]))
    cur = dag.where("u = seed").select(
        "seed", F.col("v").alias("endpoint"), F.lit(1).alias("L"),
        F.array("u", "v").alias("nodes"), F.array("lat_u", "lat_v").alias("lat"),
        *[F.array(a).alias(a) for a in attrs])
    out = cur
    for L in range(2, max_len + 1):
        nxt = cur.withColumnRenamed("endpoint", "at").join(hop, ["seed", "at"])
        cur = nxt.select(
            "seed", F.col("v").alias("endpoint"), F.lit(L).alias("L"),
            F.array_append("nodes", F.col("v")).alias("nodes"),
            F.array_append("lat", F.col("x_lat")).alias("lat"),
            *[F.array_append(a, F.col(f"x_{a}")).alias(a) for a in attrs])
        if L % cut_every == 0 and L < max_len:
            cur = materialize(cur)
            if cur.isEmpty():
                break
        out = out.unionByName(cur)
    return out.withColumn("sample_id", F.concat_ws("|", *CELL)).withColumn(
        "path_key", F.array_join("nodes", "|"))


def simple_paths(edges: DataFrame, start: DataFrame, max_len: int) -> DataFrame:
    """Simple paths over a graph without latencies, all prefixes of 1+ edges kept."""
    hop = broadcast_if_small(edges.select(F.col("u").alias("at"), "v"))
    cur = start.select(F.col("seed"), F.array("seed").alias("nodes"), F.col("seed").alias("at"))
    out = None
    for L in range(1, max_len + 1):
        cur = (cur.join(hop, "at").where(~F.array_contains("nodes", F.col("v")))
               .select("seed", F.array_append("nodes", F.col("v")).alias("nodes"),
                       F.col("v").alias("at")))
        if L % 3 == 0 and L < max_len:
            cur = materialize(cur)
            if cur.isEmpty():
                break
        rows = cur.select("seed", F.col("at").alias("endpoint"), F.lit(L).alias("L"), "nodes")
        out = rows if out is None else out.unionByName(rows)
    return out


def level_paths(onset: DataFrame, edges: DataFrame) -> DataFrame:
    """The older search over whole-unit latency levels.

    Latencies round half-even to a level.  At every level the set of open paths
    is replaced by its extensions into that level, so a path may not skip an
    occupied level; maximal results contained in a longer one are dropped.
    """
    levels = materialize(
        onset.where("lat > 0").select("seed", "node", level_key(F.col("lat")).alias("lv")))
    w = Window.partitionBy("seed").orderBy("lv")
    # ordinal of each occupied level; a seed has at most one level per node
    ranked = materialize(levels.withColumn("k", F.dense_rank().over(w)))
    top = ranked.agg(F.max("k").alias("m")).first()["m"] or 0
    hop = broadcast_if_small(edges.where("mask").select(F.col("u").alias("at"), "v"))
    cur = ranked.select("seed").distinct().select(
        "seed", F.array("seed").alias("nodes"), F.col("seed").alias("at"))
    found = None
    for k in range(1, top + 1):
        here = broadcast_if_small(ranked.where(F.col("k") == k).select(
            "seed", F.col("node").alias("v")))
        cur = materialize(
            cur.join(hop, "at").join(here, ["seed", "v"])
            .select("seed", F.array_append("nodes", F.col("v")).alias("nodes"),
                    F.col("v").alias("at")))
        if cur.isEmpty():
            break
        found = cur if found is None else found.unionByName(cur)
    if found is None:
        return cur.select("seed", "nodes")
    found = materialize(found.select("seed", "nodes"))
    # a path is contained in another iff it equals one of its runs of nodes
    runs = found.select("seed", "nodes", F.explode(F.sequence(F.lit(1), F.size("nodes"))).alias("i"))
    runs = runs.select("seed", F.size("nodes").alias("n"), "nodes", "i", F.explode(
        F.sequence(F.lit(1), F.size("nodes") - F.col("i") + 1)).alias("len"))
    inner = runs.where("len < n and len >= 2").select(
        "seed", F.slice("nodes", F.col("i"), F.col("len")).alias("nodes")).distinct()
    return found.join(inner, ["seed", "nodes"], "left_anti")


# ---- attributes of given paths ----------------------------------------------


def path_edges(paths: DataFrame, keep: list[str]) -> DataFrame:
    """One row per edge: kept columns, 1-based ``pos``, ``u``, ``v``."""
    n = F.size("nodes")
    pairs = F.arrays_zip(F.slice("nodes", 1, n - 1).alias("u"),
                         F.slice("nodes", 2, n - 1).alias("v"))
    return (paths.select(*keep, F.posexplode(pairs).alias("i", "e"))
            .select(*keep, (F.col("i") + 1).alias("pos"), F.col("e.u").alias("u"),
                    F.col("e.v").alias("v")))


def gather(paths: DataFrame, edges: DataFrame, keys: list[str], attrs: list[str]) -> DataFrame:
    """Edge attribute arrays for paths given as node arrays; NULL where no edge.

    ``keys`` identify a path; a group is one path, so it has at most L rows.
    """
    e = broadcast_if_small(edges.select("u", "v", *attrs))
    rows = path_edges(paths, [*keys, "nodes"]).join(e, ["u", "v"], "left")
    packed = rows.groupBy(*keys, "nodes").agg(
        F.array_sort(F.collect_list(F.struct("pos", *attrs))).alias("__e"))
    return packed.select(
        *keys, "nodes", *[F.col("__e")[a].alias(a) for a in attrs])


def edge_set(nodes: str = "nodes") -> Column:
    n = F.size(nodes)
    return F.zip_with(F.slice(nodes, 1, n - 1), F.slice(nodes, 2, n - 1),
                      lambda a, b: F.struct(a.alias("u"), b.alias("v")))


def edge_set_text(nodes: str = "nodes") -> Column:
    return F.array_join(F.transform(edge_set(nodes), lambda e: F.concat_ws("-", e["u"], e["v"])), ";")


def total_length(attr: str = "tract") -> Column:
    return arr_sum(attr)


def mean_weight(attr: str = "w") -> Column:
    return arr_mean(attr)


def circuit_edge_counts(paths: DataFrame, members: DataFrame) -> DataFrame:
    """Edges of every path with both ends in a circuit: (path_key, circuit, n_edges)."""
    m = broadcast_if_small(members.select("circuit", "node"))
    e = path_edges(paths, ["sample_id", "path_key"])
    both = e.join(m.withColumnRenamed("node", "u"), "u").join(
        m.withColumnRenamed("node", "v"), ["circuit", "v"])
    return both.groupBy("sample_id", "path_key", "circuit").agg(
        F.count(F.lit(1)).alias("n_edges"))


def whitelist_edges(members: DataFrame) -> DataFrame:
    """Ordered pairs of distinct members of one circuit (circuits are short lists)."""
    a = members.select("circuit", F.col("node").alias("u"))
    b = members.select("circuit", F.col("node").alias("v"))
    return a.join(b, "circuit").where("u <> v").select("u", "v").distinct()
