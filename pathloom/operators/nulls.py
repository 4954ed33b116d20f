"""Null models: reordered paths, matched path sets, permuted and rewired graphs."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.columns import arr_sum, hash_hex, hash_int, hash_mod
from pathloom.operators.graph import path_edges
from pathloom.operators.ordered import row_position
from pathloom.session import broadcast_if_small, materialize

POOL_LIMIT = 16_384  # paths one cell may bring to the greedy match
ORDER_TRIES = 20  # fixed value: reorderings tried before a path keeps its order
# fixed values of the reference: tries of a cell's walks, at least and for each walk looked for
MIN_WALK_TRIES, WALK_TRIES = 20_000, 200
WALK_BLOCK = 64  # tries dealt out together, and tries of the first round
MAX_PARTS = 2_000


def _hash_order(items: Column, tag: str, *key: Column) -> Column:
    """The items of an array in the order of their hashes."""
    tagged = F.transform(items, lambda x: F.struct(
        F.sha2(F.concat_ws("|", F.lit(tag), *[k.cast("string") for k in key],
                           x.cast("string")), 256).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda s: s["x"])


def order_shuffle(paths: DataFrame, edges: DataFrame, key: str, tag: str,
                  tries: int = ORDER_TRIES) -> DataFrame:
    """Permute the interior nodes; the first valid non-identical try wins.

    Valid means every new edge is in ``edges``.  Paths of up to two edges and
    paths without a valid try keep their order.  ``kind`` tells which.
    """
    base = paths.select(key, "nodes")
    n = F.size("nodes")
    inner = F.slice("nodes", 2, n - 2)
    tried = (base.where(n > 3)
             .select(key, "nodes", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("t"))
             .select(key, "t", F.col("nodes").alias("orig"), F.concat(
                 F.slice("nodes", 1, 1), _hash_order(inner, tag, F.col(key), F.col("t")),
                 F.slice("nodes", n, 1)).alias("nodes"))
             .where("nodes <> orig").drop("orig"))
    ok = broadcast_if_small(edges.select("u", "v").withColumn("hit", F.lit(1)))
    valid = (path_edges(tried, [key, "t", "nodes"]).join(ok, ["u", "v"], "left")
             .groupBy(key, "t", "nodes").agg(F.count_if(F.col("hit").isNull()).alias("miss"))
             .where("miss = 0"))
    found = valid.groupBy(key).agg(F.min(F.struct("t", "nodes")).alias("b")).select(
        key, F.col("b.nodes").alias("new"))
    out = base.join(found, key, "left")
    return out.select(
        key, "nodes", F.coalesce("new", "nodes").alias("shuffled"),
        F.when(n <= 3, "no_interior").when(F.col("new").isNull(), "fallback")
        .otherwise("shuffled").alias("kind"))


def edge_order(L: Column, tag: str, key: Column, tries: int = ORDER_TRIES) -> Column:
    """A non-identical permutation of the edge positions 0..L-1 (identity for L < 2)."""
    ident = F.sequence(F.lit(0), L - 1)
    cands = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)),
                        lambda t: _hash_order(F.sequence(F.lit(0), L - 1), tag, key, t))
    moved = F.filter(cands, lambda c: c != ident)
    return F.when(L < 2, ident).otherwise(F.coalesce(F.try_element_at(moved, F.lit(1)), ident))


def permute(a: str, order: str) -> Column:
    """Array ``a`` read in the 0-based ``order``."""
    return F.transform(F.col(order), lambda i: F.element_at(F.col(a), i + 1))


def latency_permutation(onset: DataFrame, half: int, tag: str) -> DataFrame:
    """Permute the latencies of every seed among the nodes of its half.

    A window group is one seed's half of the graph.
    """
    inside = onset.where((F.col("node") < half) == (F.col("seed") < half)).where("node <> seed")
    by_node = Window.partitionBy("seed").orderBy("node")
    by_hash = Window.partitionBy("seed").orderBy(hash_hex(tag, F.col("seed"), F.col("node")), "node")
    spots = inside.select("seed", "node", F.row_number().over(by_node).alias("i"))
    lats = inside.select("seed", "lat", F.row_number().over(by_hash).alias("i"))
    return spots.join(lats, ["seed", "i"]).select("seed", "node", "lat")


def rewire(edges: DataFrame, half: int, tag: str, per_edge: int = 4, patience: int = 20
           ) -> DataFrame:
    """Degree-preserving exchanges of edge ends in the undirected mask, per half.

    In every round the edges of a half are paired at random; all pairs whose exchange keeps
    the graph simple and doesn't collide with another one of the round take place at once.
    Rounds go on until ``per_edge`` exchanges an edge are made, at most
    ``per_edge * patience`` of them.  A half is one task: its size is bounded by the square
    of its nodes, whatever the size of the source tables.
    """
    und = edges.where(F.col("mask") & ((F.col("u") < half) == (F.col("v") < half))).select(
        (F.col("u") < half).alias("left"), F.least("u", "v").alias("a"),
        F.greatest("u", "v").alias("b")).distinct()

    def swap(pdf: pd.DataFrame) -> pd.DataFrame:
        left = bool(pdf["left"].iloc[0])
        seed = int.from_bytes(hashlib.sha256(f"{tag}|{int(left)}".encode()).digest()[:8], "big")
        rng = np.random.default_rng(seed)
        pdf = pdf.sort_values(["a", "b"])
        nodes, ends = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
        ends = ends.reshape(-1, 2)
        linked = np.zeros((len(nodes), len(nodes)), bool)
        linked[ends[:, 0], ends[:, 1]] = linked[ends[:, 1], ends[:, 0]] = True
        todo, m = per_edge * len(ends), len(ends) // 2
        for _ in range(per_edge * patience):
            if todo <= 0 or not m:
                break
            order = rng.permutation(len(ends))
            one, two = order[:m], order[m:2 * m]
            x = ends[one]
            y = np.where(rng.integers(0, 2, (m, 1)) == 1, ends[two], ends[two][:, ::-1])
            fresh = np.stack([np.c_[x[:, 0], y[:, 1]], np.c_[y[:, 0], x[:, 1]]], axis=1)  # pair, edge, end
            code = fresh.min(axis=2) * len(nodes) + fresh.max(axis=2)
            times = np.unique(code, return_inverse=True, return_counts=True)
            alone = (times[2][times[1].reshape(code.shape)] == 1).all(axis=1)
            apart = (x[:, :, None] != y[:, None, :]).all(axis=(1, 2))
            ok = np.flatnonzero(alone & apart & ~linked[fresh[..., 0], fresh[..., 1]].any(axis=1))[:todo]
            for old in (x[ok], y[ok]):
                linked[old[:, 0], old[:, 1]] = linked[old[:, 1], old[:, 0]] = False
            for which, new in ((one, fresh[ok, 0]), (two, fresh[ok, 1])):
                linked[new[:, 0], new[:, 1]] = linked[new[:, 1], new[:, 0]] = True
                ends[which[ok]] = new
            todo -= len(ok)
        out = np.sort(nodes[ends], axis=1)
        return pd.DataFrame({"left": left, "a": out[:, 0], "b": out[:, 1]}).astype(pdf.dtypes.to_dict())

    return und.groupBy("left").applyInPandas(swap, und.schema)


def match_greedy(target: DataFrame, pool: DataFrame, cell: list[str], value: str = "mean_w"
                 ) -> DataFrame:
    """One-to-one nearest match without replacement, targets in ascending order.

    Sequential inside a cell, parallel over cells.  Targets and pools are rank
    samples; a cell beyond ``POOL_LIMIT`` rows is an error, not a silent cut.
    """
    schema = target.select(*cell).schema.add("target_key", "string").add("pool_key", "string") \
        .add("gap", "double")

    def go(key, t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if max(len(t), len(p)) > POOL_LIMIT:
            raise ValueError("matching works on rank samples")
        t = t.sort_values([value, "path_key"], kind="stable")
        p = p.sort_values("path_key", kind="stable")
        free = p[value].to_numpy(dtype=float).copy()
        out = []
        for tk, tv in zip(t["path_key"], t[value]):
            gap = np.abs(free - tv)
            if not len(gap) or not np.isfinite(gap).any():
                break
            j = int(np.nanargmin(gap))
            out.append((*key, tk, p["path_key"].iloc[j], float(gap[j])))
            free[j] = np.nan
        return pd.DataFrame(out, columns=[f.name for f in schema])

    return target.groupBy(*cell).cogroup(pool.groupBy(*cell)).applyInPandas(go, schema)


def _band_walks(todo: DataFrame, hop: DataFrame, half: int, tag: str, start: int, end: int
                ) -> DataFrame:
    """The tries ``start`` .. ``end`` - 1 (below each cell's ``bound``) that end inside the band."""
    cell = ["seed", "endpoint", "L"]
    last = F.least(F.col("bound"), F.lit(end)) - 1
    sums = todo.agg(F.max("L").alias("m"), F.sum(F.ceil((last - start + 1) / WALK_BLOCK)).alias("b")).first()
    # whole blocks of tries are dealt out, so that a cell's tries spread over tasks
    parts = max(todo.sparkSession.sparkContext.defaultParallelism, min(int(sums["b"]) // 128, MAX_PARTS))
    blocks = todo.select(*cell, "med_len", "n_paths", last.alias("last"), F.explode(
        F.sequence(F.lit(start), last, F.lit(WALK_BLOCK))).alias("b")).repartition(parts)
    cur = blocks.select(
        *cell, "med_len", "n_paths",
        F.explode(F.sequence("b", F.least(F.col("b") + WALK_BLOCK - 1, F.col("last")))).alias("t"),
        F.array("seed").alias("nodes"), F.lit(0.0).alias("len"), F.col("seed").alias("u"))
    for i in range(sums["m"]):
        free = F.filter("next", lambda e: ((e["v"] < half) == (F.col("seed") < half))
                        & ~F.array_contains("nodes", e["v"]))
        cur = cur.join(hop, "u", "left").withColumn("free", F.coalesce(
            free, F.array().cast("array<struct<v:int,tract:double>>")))
        h = F.pmod(hash_int(tag, *[F.col(c) for c in cell], F.col("t"), F.lit(i)),
                   F.greatest(F.size("free"), F.lit(1)).cast("bigint")).cast("int")
        nxt = F.try_element_at("free", h + 1)
        done = F.col("L") <= i
        cur = cur.where(done | (F.size("free") > 0)).select(
            *cell, "med_len", "n_paths", "t",
            F.when(done, F.col("nodes")).otherwise(F.array_append("nodes", nxt["v"])).alias("nodes"),
            F.when(done, F.col("len")).otherwise(F.col("len") + nxt["tract"]).alias("len"),
            F.when(done, F.col("u")).otherwise(nxt["v"]).alias("u"))
        if (i + 1) % 4 == 0:
            cur = materialize(cur)
    ok = cur.where(F.col("len").between(0.75 * F.col("med_len"), 1.25 * F.col("med_len")))
    return ok.select(*cell, "n_paths", "t", "nodes", "len")


def matched_walks(cells: DataFrame, edges: DataFrame, half: int, tag: str,
                  tries: int | None = None) -> DataFrame:
    """Self-avoiding walks of the cell's length whose total length is near the median.

    ``cells`` has (seed, endpoint, L, med_len, n_paths).  Per cell the first ``n_paths``
    hashed tries within 25 percent of ``med_len`` stay.  Tries are made in growing rounds,
    one join per hop, for the cells still short, until none is or the bound is reached:
    ``tries`` a cell, by default the reference's max(20000, 200 * n_paths).  A cell may
    still end short (see ``with_shortfall``).
    """
    cell = ["seed", "endpoint", "L"]
    hop = broadcast_if_small(edges.where("mask").groupBy("u").agg(
        F.array_sort(F.collect_list(F.struct("v", "tract"))).alias("next")))
    bound = F.lit(tries) if tries is not None else F.greatest(
        F.lit(MIN_WALK_TRIES), F.col("n_paths") * WALK_TRIES)
    todo = cells.select(*cell, "med_len", "n_paths", bound.cast("int").alias("bound"),
                        F.lit(0).cast("bigint").alias("found")).where("n_paths > 0 and bound > 0")
    out, start, end = None, 0, WALK_BLOCK
    while not todo.isEmpty():
        new = materialize(_band_walks(todo, hop, half, tag, start, end))
        out = new if out is None else out.unionByName(new)
        n = new.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
        todo = materialize(todo.join(n, cell, "left").withColumn(
            "found", F.col("found") + F.coalesce("n", F.lit(0))).drop("n").where(
            (F.col("found") < F.col("n_paths")) & (F.col("bound") > end)))
        start, end = end, end * 8
    if out is None:
        return cells.limit(0).select(*cell, F.lit(0).alias("t"), F.array("seed").alias("nodes"),
                                     F.lit(0.0).alias("len"))
    w = Window.partitionBy(*cell).orderBy("t")
    return (out.withColumn("i", F.row_number().over(w)).where("i <= n_paths")
            .select(*cell, "t", "nodes", "len"))


def with_shortfall(cells: DataFrame, walks: DataFrame) -> DataFrame:
    """``walks`` with how many of its cell's ``n_paths`` were not found; a cell without a walk
    has one row with NULL in the other columns."""
    cell = ["seed", "endpoint", "L"]
    n = walks.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    short = cells.join(n, cell, "left").select(
        *cell, (F.col("n_paths") - F.coalesce("n", F.lit(0))).alias("shortfall"))
    return short.join(walks, cell, "left")


def total_of(a: str) -> Column:
    return arr_sum(a)


def exchange_rounds(edges: DataFrame, group: str, tag: str, per_edge: int = 4, patience: int = 20) -> DataFrame:
    """Degree-preserving exchanges of edge ends as joins: (group, a, b) with a < b.

    Every round puts the edges of a group into a new hash order and pairs neighbours; a pair
    (a, b), (c, d) asks for (a, d), (c, b), or with c and d swapped.  It gets them if the four
    ends differ and no edge and no other pair of the round holds or asks for one of the two.
    A group goes on until ``per_edge`` exchanges an edge are made, at most ``per_edge *
    patience`` rounds.  Pairing, conflicts and exchanges are shuffled by edge, so a group may
    hold any number of edges; the driver sees a count a group and round.
    """
    cur = materialize(edges.select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = {r[group]: per_edge * r["count"] for r in cur.groupBy(group).count().collect()}  # one row per half
    made = dict.fromkeys(wanted, 0)
    finished = None
    for t in range(per_edge * patience):
        over = [g for g in wanted if g in made and made[g] >= wanted[g]]
        if over:
            out = cur.where(F.col(group).isin(over)).select(group, "a", "b")
            finished = out if finished is None else finished.unionByName(out)
            cur = cur.where(~F.col(group).isin(over))
            for g in over:
                del made[g]
        if not made:
            break
        cur = materialize(_exchange(cur.select(group, "a", "b"), group, tag, t))
        for r in cur.groupBy(group).agg(F.count_if("moved").alias("n")).collect():
            made[r[group]] += r["n"] // 2
    rest = cur.select(group, "a", "b")
    return rest if finished is None else finished.unionByName(rest)


def _exchange(cur: DataFrame, group: str, tag: str, t: int) -> DataFrame:
    """One round of :func:`exchange_rounds`: (group, a, b, moved)."""
    placed = row_position(cur.withColumn("h", hash_hex(tag, t, F.col("a"), F.col("b"))), [group], ["h", "a", "b"])
    pair = placed.groupBy(group, F.expr("(pos - 1) div 2").alias("pair")).agg(
        F.min(F.struct("pos", "a", "b")).alias("x"), F.max(F.struct("pos", "a", "b")).alias("y"), F.count(F.lit(1)).alias("k"))
    swap = hash_mod(2, tag, "flip", t, F.col("x.a"), F.col("x.b")) == 1
    ends = F.array("x.a", "x.b", "y.a", "y.b")
    edge = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    c, d = F.when(swap, F.col("y.b")).otherwise(F.col("y.a")), F.when(swap, F.col("y.a")).otherwise(F.col("y.b"))
    asked = pair.withColumn("new", F.when((F.col("k") == 2) & (F.size(F.array_distinct(ends)) == 4), F.array(
        edge(F.col("x.a"), d), edge(c, F.col("x.b")))))
    claims = asked.where("new is not null").select(group, "pair", F.explode("new").alias("e")).select(group, "pair", "e.a", "e.b")
    free = claims.unionByName(cur.select(group, F.lit(None).cast("bigint").alias("pair"), "a", "b")).groupBy(group, "a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.max("pair").alias("pair")).where("n = 1 and pair is not null")
    granted = free.groupBy(group, "pair").count().where("count = 2").select(group, "pair", F.lit(True).alias("ok"))
    old = F.when(F.col("k") == 2, F.array(edge(F.col("x.a"), F.col("x.b")), edge(F.col("y.a"), F.col("y.b")))).otherwise(
        F.array(edge(F.col("x.a"), F.col("x.b"))))
    return asked.join(granted, [group, "pair"], "left").select(
        group, F.coalesce("ok", F.lit(False)).alias("moved"), F.explode(F.when(F.col("ok"), F.col("new")).otherwise(old)).alias("e")
    ).select(group, "e.a", "e.b", "moved")


def rewired_mask(edges: DataFrame, half: int, tag: str) -> DataFrame:
    """``edges`` with the mask exchanged inside both halves: a pair is masked in both directions
    if the exchanged graph holds it; between the halves the mask stays."""
    left = F.col("u") < half
    inside = left == (F.col("v") < half)
    und = edges.where(F.col("mask") & inside).select(
        left.alias("left"), F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    new = exchange_rounds(und, "left", tag).select("a", "b", F.lit(True).alias("linked"))
    j = edges.withColumn("a", F.least("u", "v")).withColumn("b", F.greatest("u", "v")).join(
        broadcast_if_small(materialize(new)), ["a", "b"], "left")
    return j.withColumn("mask", F.when(inside, F.coalesce("linked", F.lit(False))).otherwise(F.col("mask"))).select(*edges.columns)


def match_findings(pairs: DataFrame, target: DataFrame, pool: DataFrame, cell: list[str], value: str = "mean_w") -> DataFrame:
    """Breaches of the rule of :func:`match_greedy`: (finding, n), all 0 for a right match.

    Targets left over while the pool had paths, pool paths used twice or unknown, and pairs
    whose target had a nearer pool path that no earlier target took.  The last compares the
    samples of one cell with each other.
    """
    order = Window.partitionBy(*cell).orderBy(value, "path_key")
    t = target.select(*cell, F.col("path_key").alias("target_key"), F.col(value).alias("tv"), F.row_number().over(order).alias("turn"))
    p = pool.select(*cell, F.col("path_key").alias("pool_key"), F.col(value).alias("pv"))
    m = materialize(pairs.join(t, [*cell, "target_key"]).join(p, [*cell, "pool_key"], "left"))
    left = [x.groupBy(*cell).agg(F.count(F.lit(1)).alias(n)) for x, n in ((t, "nt"), (p, "np"), (pairs, "nm"))]
    short = left[0].join(left[1], cell).join(left[2], cell, "left").agg(
        F.sum(F.least("nt", "np") - F.coalesce("nm", F.lit(0))).alias("n"))
    twice = pairs.groupBy(*cell, "pool_key").count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    taken = m.select(*cell, "pool_key", F.col("turn").alias("taken"))
    free = p.join(taken, [*cell, "pool_key"], "left").select(*cell, "pv", "taken")
    near = m.select(*cell, "turn", "tv", "gap").join(free, cell).where(
        (F.col("taken").isNull() | (F.col("taken") >= F.col("turn"))) & (F.abs(F.col("pv") - F.col("tv")) < F.col("gap") - 1e-12))
    found = [("unmatched target", short), ("pool path used twice", twice),
             ("not in the pool", m.where("pv is null").agg(F.count(F.lit(1)).alias("n"))),
             ("nearer path was free", near.agg(F.count(F.lit(1)).alias("n")))]
    out = [x.select(F.lit(name).alias("finding"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n")) for name, x in found]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
