"""Paths, screens, diversity and null models on random small graphs, against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions.columns import slope
from pathloom.operators import commetrics as M
from pathloom.operators import diversity as D
from pathloom.operators import features as V
from pathloom.operators import graph as G
from pathloom.operators import nulls as N
from pathloom.operators import screens as S
from pathloom.session import materialize

NODES, MAX_LEN = 9, 5


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(11)
    rows = []
    for u, v in itertools.permutations(range(NODES), 2):
        lat = float(rng.integers(1, 12))  # ties on purpose
        rows.append((u, v, int(rng.integers(1, 100)), lat, float(rng.uniform(1, 9)),
                     *[float(x) for x in rng.uniform(0, 3, 4)], bool(rng.random() < 0.6)))
    df = spark.createDataFrame(rows, "u int, v int, w long, lat double, tract double, nav double, "
                                     "rout double, search double, comm double, mask boolean")
    return rows, materialize(df)


@pytest.fixture(scope="module")
def truth(graph):
    """All strictly time-ordered masked paths by plain depth-first search."""
    rows, _ = graph
    lat = {(r[0], r[1]): r[3] for r in rows}
    ok = {(r[0], r[1]) for r in rows if r[-1]}
    out = set()

    def walk(path, seed):
        if len(path) > 1:
            out.add(tuple(path))
        if len(path) <= MAX_LEN:
            here = 0.0 if path[-1] == seed else lat[seed, path[-1]]
            for v in range(NODES):
                if v != seed and (path[-1], v) in ok and lat[seed, v] > here:
                    walk([*path, v], seed)

    for s in range(NODES):
        walk([s], s)
    return {p for p in out if len(p) <= MAX_LEN + 1}


@pytest.fixture(scope="module")
def dag(graph):
    _, e = graph
    return materialize(G.seed_dag(G.onset_table(e), e))


def test_listing_and_counts(dag, truth):
    got = {tuple(r["nodes"]) for r in G.enumerate_paths(dag, MAX_LEN).collect()}
    assert got == truth
    counts = {(r["seed"], r["endpoint"], r["L"]): r["cnt"] for r in G.count_paths(dag, MAX_LEN, 2).collect()}
    want = {}
    for p in truth:
        k = (p[0], p[-1], len(p) - 1)
        want[k] = want.get(k, 0) + 1
    assert counts == want


def test_unranking_is_a_bijection_in_rank_order(dag, truth):
    rest = materialize(G.remaining_counts(dag, MAX_LEN, 2))
    totals = rest.where("u = seed and rem > 0").select("seed", "endpoint", F.col("rem").alias("L"), "cnt")
    ranks = totals.select(*G.CELL, F.explode(F.expr("sequence(0L, cnt - 1)")).alias("rank"))
    got = G.unrank(ranks, G.child_ranges(dag, rest), MAX_LEN, 2).collect()
    assert len(got) == len(truth)
    cells = {}
    for r in got:
        cells.setdefault((r["seed"], r["endpoint"], r["L"]), []).append((r["rank"], tuple(r["nodes"])))
    for (s, e, L), items in cells.items():
        want = sorted(p for p in truth if p[0] == s and p[-1] == e and len(p) == L + 1)
        assert [p for _, p in sorted(items)] == want


def test_ranks_out_of_range(spark, dag):
    totals = G.count_paths(dag, 2)
    bad = totals.select(*G.CELL, F.col("cnt").alias("rank"))
    with pytest.raises(Exception, match="rank outside"):
        G.check_ranks(bad, totals).collect()


@pytest.mark.parametrize("k", [1, 3])
def test_rank_samples(dag, truth, k):
    got = G.sample_ranks(G.count_paths(dag, MAX_LEN), k, "s").collect()
    want = {}
    for p in truth:
        c = (p[0], p[-1], len(p) - 1)
        want[c] = want.get(c, 0) + 1
    seen = {}
    for r in got:
        c = (r["seed"], r["endpoint"], r["L"])
        assert 0 <= r["rank"] < want[c]
        seen.setdefault(c, set()).add(r["rank"])
    assert {c: len(v) for c, v in seen.items()} == {c: min(k, n) for c, n in want.items()}


def test_random_walks_are_paths(dag, truth):
    got = [tuple(r["nodes"]) for r in G.random_walks(dag, MAX_LEN, 3, "w").collect()]
    assert len(got) == len(set(got)) and set(got) <= truth
    by = {}
    for p in got:
        by[p[0], p[-1], len(p)] = by.get((p[0], p[-1], len(p)), 0) + 1
    full = {}
    for p in truth:
        full[p[0], p[-1], len(p)] = full.get((p[0], p[-1], len(p)), 0) + 1
    assert by == {k: min(3, n) for k, n in full.items()}


def test_level_search_matches_frontier_replacement(graph):
    rows, e = graph
    got = {tuple(r["nodes"]) for r in G.level_paths(G.onset_table(e), e).collect()}
    lat = {(r[0], r[1]): r[3] for r in rows}
    ok = {(r[0], r[1]) for r in rows if r[-1]}
    want = set()
    for s in range(NODES):
        levels = sorted({round(lat[s, v]) for v in range(NODES) if v != s})
        open_, all_ = [(s,)], []
        for lv in levels:
            here = [v for v in range(NODES) if v != s and round(lat[s, v]) == lv]
            open_ = [(*p, v) for p in open_ for v in here if (p[-1], v) in ok]
            all_ += open_
        runs = lambda p: {p[i:j] for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        want |= {p for p in all_ if not any(p != q and p in runs(q) for q in all_)}
    assert got == want


def test_screens_do_not_see_the_outcome(dag):
    p = G.enumerate_paths(dag, 3)
    base = S.apply_screen(p, "B2", S.ScreenParams()).select("path_key", "reject_reason")
    fake = S.apply_screen(p.withColumn("canary", F.rand()), "B2", S.ScreenParams()).select(
        "path_key", "reject_reason")
    assert base.exceptAll(fake).isEmpty()
    with pytest.raises(ValueError):
        S.apply_screen(p.withColumn("y_true", F.lit(1.0)), "B2", S.ScreenParams())


def _jac(p, q):
    a, b = set(zip(p, p[1:])), set(zip(q, q[1:]))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("t", [0.2, 0.34, 0.5])
def test_similar_pairs_are_exact(dag, truth, t):
    p = G.enumerate_paths(dag.select("seed", "u", "v", "lat_u", "lat_v"), MAX_LEN)
    got = {(r["a"], r["b"]): r["jaccard"] for r in D.similar_pairs(p, ["sample_id"], "path_key", t).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(truth), 2):
        if a[0] == b[0] and a[-1] == b[-1] and len(a) == len(b) and _jac(a, b) >= t - 1e-12:
            k = tuple(sorted(("|".join(map(str, a)), "|".join(map(str, b)))))
            want[k] = _jac(a, b)
    assert got == pytest.approx(want)


def test_diverse_selection_properties(dag, truth):
    p = G.enumerate_paths(dag.select("seed", "u", "v", "lat_u", "lat_v"), MAX_LEN)
    got = {}
    for r in D.diverse_paths(p, G.CELL, keep=3, jaccard=0.8).collect():
        got.setdefault((r["seed"], r["endpoint"], r["L"]), []).append((r["pick"], tuple(r["nodes"])))
    for (s, e, L), items in got.items():
        cell = sorted(q for q in truth if q[0] == s and q[-1] == e and len(q) == L + 1)
        chosen = [q for _, q in sorted(items)]
        assert len(chosen) == min(3, len(cell)) and set(chosen) <= set(cell)
        if len(cell) > 3:  # no two of these short paths reach 0.8, so every path is its own medoid
            sel = [cell[0]]
            while len(sel) < 3:
                rest = [q for q in cell if q not in sel]
                sel.append(max(rest, key=lambda q: (round(min(1 - _jac(q, c) for c in sel), 9),
                                                    [-x for x in q])))
            assert chosen == sel


def test_complete_link_merges_within_the_cut():
    rng = np.random.default_rng(0)
    x = rng.random((30, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    groups = D._complete_link(d, 0.4)
    assert sorted(i for g in groups for i in g) == list(range(30))
    for g in groups:
        assert d[np.ix_(g, g)].max() <= 0.4 + 1e-9
    for a, b in itertools.combinations(groups, 2):
        assert d[np.ix_(a, b)].max() > 0.4


def test_ordered_basis_recovers_cubics(spark):
    c = [0.5, -1.0, 2.0, 0.25]
    rows = []
    for L in range(4, 12):
        z = np.linspace(-1, 1, L)
        rows.append((L, [float(v) for v in np.polynomial.legendre.legval(z, c)]))
    df = spark.createDataFrame(rows, "L int, nav array<double>")
    for q in range(4):
        for r in df.select(V.basis_coefficient("nav", q, 12).alias("b")).collect():
            assert r["b"] == pytest.approx(c[q], abs=1e-10)


def test_slope(spark):
    df = spark.createDataFrame([([1.0, 4.0, 2.0, 8.0],), ([5.0],)], "a array<double>")
    got = [r[0] for r in df.select(slope("a")).collect()]
    assert got == pytest.approx([np.polyfit(np.linspace(0, 1, 4), [1, 4, 2, 8], 1)[0], 0.0])


def test_shortest_paths_and_efficiency(graph, spark):
    rows, e = graph
    w = e.where("mask").select("u", "v", F.col("tract").alias("x"))
    d = M.floyd_reference(NODES, [(r[0], r[1], r[4]) for r in rows if r[-1]])
    got = {(r["u"], r["v"]): r["x"] for r in M.routing_efficiency(w).collect()}
    want = {(i, j): 1 / d[i][j] for i in range(NODES) for j in range(NODES)
            if i != j and math.isfinite(d[i][j])}
    assert got == pytest.approx(want, abs=1e-9)


def test_navigation_walks(graph):
    rows, e = graph
    length = {(r[0], r[1]): r[4] for r in rows if r[-1]}
    dist = {(r[0], r[1]): r[3] for r in rows}
    w = e.where("mask").select("u", "v", F.col("tract").alias("x"))
    dd = e.select("u", "v", F.col("lat").alias("x")).unionByName(
        e.select("u").distinct().select("u", F.col("u").alias("v"), F.lit(0.0).alias("x")))
    got = {(r["u"], r["v"]): r["x"] for r in M.navigation_efficiency(w, dd, 50).collect()}
    want = {}
    for i, t in itertools.permutations(range(NODES), 2):
        cur, last, total, hops = i, i, 0.0, 0
        while cur != t:
            nb = [v for v in range(NODES) if (cur, v) in length]
            if not nb:
                break
            nxt = min(nb, key=lambda v: (0.0 if v == t else dist[t, v], v))
            if nxt == last or hops >= 50:
                break
            total, last, cur, hops = total + length[cur, nxt], cur, nxt, hops + 1
        if cur == t:
            want[i, t] = 1 / total
    assert got == pytest.approx(want)


def test_search_information_symmetric_mode(spark):
    sym = [(0, 1, .5), (1, 0, .5), (1, 2, .25), (2, 1, .25)]
    df = spark.createDataFrame(sym, "u int, v int, x double")
    got = {(r["u"], r["v"]): r["x"] for r in M.search_information(df, symmetric=True).collect()}
    assert got[0, 2] == pytest.approx(-math.log2(1.0 * (.25 / .75)))
    assert got[2, 0] == pytest.approx(-math.log2(1.0 * (.5 / .75)))


def test_communicability(spark):
    rng = np.random.default_rng(4)
    a = rng.random((6, 6)) * (rng.random((6, 6)) < 0.6)
    np.fill_diagonal(a, 0)
    df = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(6) if a[i, j]],
                               "u int, v int, x double")
    s = a.sum(1)
    s[s == 0] = 1
    w = a / np.sqrt(np.outer(s, s))
    want, term = np.eye(6), np.eye(6)
    for k in range(1, 25):
        term = term @ w / k
        want = want + term
    got = {(r["u"], r["v"]): r["x"] for r in M.communicability(df, 24).collect()}
    for (u, v), x in got.items():
        assert x == pytest.approx(want[u, v], abs=1e-9)


def test_shuffles_keep_ends_and_multisets(graph, dag):
    _, e = graph
    p = G.enumerate_paths(dag.select("seed", "u", "v", "lat_u", "lat_v"), MAX_LEN)
    ok = {(r["u"], r["v"]) for r in e.where("mask").collect()}
    kinds = set()
    for r in N.order_shuffle(p, e.where("mask"), "path_key", "t").collect():
        a, b = r["nodes"], r["shuffled"]
        kinds.add(r["kind"])
        assert sorted(a) == sorted(b) and a[0] == b[0] and a[-1] == b[-1]
        if r["kind"] == "shuffled":
            assert a != b and all(x in ok for x in zip(b, b[1:]))
        else:
            assert a == b
    assert kinds == {"shuffled", "fallback", "no_interior"}
    o = p.select("L", N.edge_order(F.col("L"), "t", F.col("path_key")).alias("o")).collect()
    assert all(sorted(r["o"]) == list(range(r["L"])) for r in o)
    assert all(r["o"] != list(range(r["L"])) for r in o if r["L"] > 1)


def test_rewiring_keeps_degrees(graph):
    _, e = graph
    new = N.rewire(e, NODES, "t").collect()
    pairs = {(min(r["u"], r["v"]), max(r["u"], r["v"])) for r in e.where("mask").collect()}
    deg = lambda ps: sorted(sum(i in p for p in ps) for i in range(NODES))
    got = {(r["a"], r["b"]) for r in new}
    assert len(got) == len(new) == len(pairs)
    for i in range(NODES):
        assert sum(i in p for p in got) == sum(i in p for p in pairs)
    assert deg(got) == deg(pairs)


def test_latency_permutation_keeps_values(graph):
    _, e = graph
    on = G.onset_table(e)
    got = N.latency_permutation(on, NODES, "t")
    want = on.where("node <> seed")
    key = lambda d: sorted((r["seed"], r["lat"]) for r in d.collect())
    assert key(got) == key(want)
    assert not got.exceptAll(want.select("seed", "node", "lat")).isEmpty()


def test_greedy_matching(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "cell int, path_key string, mean_w double")
    p = spark.createDataFrame([(1, "x", 1.9), (1, "y", 1.2), (1, "z", 9.0)],
                              "cell int, path_key string, mean_w double")
    got = {r["target_key"]: r["pool_key"] for r in N.match_greedy(t, p, ["cell"]).collect()}
    assert got == {"a": "y", "b": "x"}


def test_matched_walks_stay_in_band(graph, dag):
    _, e = graph
    p = G.gather(G.enumerate_paths(dag.select("seed", "u", "v", "lat_u", "lat_v"), 3), e, G.CELL, ["tract"])
    cells = p.select(*G.CELL, F.expr("aggregate(tract, 0D, (a, x) -> a + x)").alias("len")).groupBy(
        *G.CELL).agg(F.percentile("len", 0.5).alias("med_len"), F.count(F.lit(1)).alias("n_paths"))
    walks = N.matched_walks(materialize(cells), e, NODES, "t", 30)
    bad = walks.join(cells, G.CELL).where("not len between 0.75 * med_len and 1.25 * med_len")
    assert bad.isEmpty() and walks.count() > 0
    for r in walks.collect():
        assert len(set(r["nodes"])) == r["L"] + 1 and r["nodes"][0] == r["seed"]
