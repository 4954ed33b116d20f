"""Queries that once did a part of their job, against plain Python."""

import hashlib
from collections import defaultdict

from pathloom.plans import fixture as fx
from pathloom.plans import load_all

SF = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def test_latency_null_search_walks_all_lengths(spark):
    lat, out = {}, defaultdict(set)
    for r in fx.edges(spark, SF).select("u", "v", "lat", "mask").collect():
        if r["lat"] > 0:
            lat[r["u"], r["v"]] = r["lat"]
        if r["mask"]:
            out[r["u"]].add(r["v"])
        lat[r["u"], r["u"]] = 0.0
    counts = defaultdict(int)
    for seed in {s for s, _ in lat}:
        spots = sorted(n for s, n in lat if s == seed and n != seed and (n < 13) == (seed < 13))
        dealt = sorted(spots, key=lambda n: (sha("lat", seed, n), n))
        at = {n: lat[seed, d] for n, d in zip(spots, dealt)} | {seed: 0.0}
        here = {seed: 1}
        for L in range(1, fx.MAX_LEN + 1):
            new = defaultdict(int)
            for u, n in here.items():
                for v in out[u]:
                    if v in at and at[v] > at[u]:
                        new[v] += n
            here = new
            counts[L] += sum(new.values())
    want = {L: n for L, n in counts.items() if n}
    got = {r["L"]: r["n_paths"] for r in load_all()[0]["latency_null_search"](spark, SF).collect()}
    assert got == want and max(got) > 2


def test_folds_of_all_repeats(spark):
    queries = load_all()[0]
    sizes = {r["o_custkey"]: r["count"] for r in spark.read.parquet(f"{SF}/orders.parquet").groupBy(
        "o_custkey").count().collect()}
    want = set()
    for repeat in range(5):
        load = [0] * 5
        for g in sorted(sizes, key=lambda g: (-sizes[g], sha("fold", repeat, g), g)):
            fold = load.index(min(load))
            load[fold] += sizes[g]
            want.add((repeat, g, fold))
    assert {tuple(r) for r in queries["fold_manifest"](spark, SF).collect()} == want
    every = {(r, f) for r in range(5) for f in range(5)}
    for name, fold in (("fold_sizes", "test_fold"), ("train_medians", "outer_fold")):
        rows = queries[name](spark, SF).select("repeat", fold).collect()
        assert sorted(map(tuple, rows)) == sorted(every)
    assert {r["repeat"] for r in queries["fold_size_summary"](spark, SF).collect()} == set(range(5))


def test_order_shuffles_of_all_folds(spark):
    rows = load_all()[0]["order_shuffle_by_fold"](spark, "/root/testdata/sf0.01").collect()
    assert {(r["repeat"], r["fold"]) for r in rows} == {(r, f) for r in range(5) for f in range(5)}


def test_coverage_counts_supported_cells(spark):
    queries, every, kept = load_all()[0], defaultdict(set), defaultdict(set)
    for r in queries["support_rule"](spark, "/root/testdata/sf0.01").collect():
        every[r["seed"]].add(r["endpoint"])
        if r["in_support"]:
            kept[r["seed"]].add(r["endpoint"])
    got = {r["seed"]: (r["n_kept"], r["n_all"]) for r in queries["coverage"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {s: (len(kept[s]), len(v)) for s, v in every.items()} and any(map(len, kept.values()))


def test_label_permutation_makes_all_draws(spark):
    import numpy as np

    from pathloom.plans import cohort_queries as cq

    rows = sorted((r["label"], r["cls"], r["x"]) for r in cq.target_values(spark, SF).collect())
    cls = np.array([r[1] for r in rows])

    def f_of(x):
        groups = [x[cls == c] for c in set(cls)]
        between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups) / (len(groups) - 1)
        return between / (sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(x) - len(groups)))

    x = {r[0]: r[2] for r in rows}
    null = [f_of(np.array([x[k] for k in sorted(x, key=lambda k: (sha("perm", d, k), k))])) for d in range(10_000)]
    seen = f_of(np.array([r[2] for r in rows]))
    got = load_all()[0]["random_label_permutation"](spark, SF).first()
    assert got["p"] == (sum(round(f, 9) >= round(seen, 9) for f in null) + 1) / 10_001
    assert abs(got["null_mean"] - np.mean(null)) < 2e-6


def test_mean_difference_bootstrap_makes_all_draws(spark):
    rows = load_all()[0]["mean_difference_bootstrap"](spark, SF).collect()
    assert sorted(r["draw"] for r in rows) == list(range(10_000))
    ev = spark.read.parquet(f"{SF}/events.parquet").where("event_type in ('click', 'view')").selectExpr(
        "event_type = 'click' y", "event_id", "round(value * 100) x").collect()
    kinds = {y: [r["x"] for r in sorted(ev, key=lambda r: r["event_id"]) if r["y"] == y] for y in (True, False)}
    got = {r["draw"]: r["delta"] for r in rows}
    for draw in (0, 29, 30, 9_999):
        mean = {y: sum(v[int(sha("md", draw, int(y), i)[:13], 16) % len(v)] for i in range(len(v))) / len(v)
                for y, v in kinds.items()}
        assert abs(got[draw] - (mean[True] - mean[False])) < 2e-6


def test_matched_random_pool_leaves_a_choice(spark, monkeypatch):
    from pathloom.plans import feature_queries as fq

    pools = []
    monkeypatch.setattr(fq.N, "match_greedy", lambda t, p, cell: pools.append((t, p)))
    monkeypatch.setattr(fq, "sampled", lambda spark, sf, tag="cand", k=fq.SAMPLE_K: (
        None, None, spark.range(k).selectExpr("0 seed", "0 endpoint", "1 L", "id path_key", "array(1D) w")))
    fq.matched_random(spark, SF)
    (target, pool), = pools
    assert (target.count(), pool.count()) == (512, 1024)
