"""Fits from cross-product sums against direct solutions; folds; group tests."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import special as Sp
from pathloom.operators import cohort as C
from pathloom.operators import folds as Fo
from pathloom.operators import inference as I
from pathloom.operators import models as Mo
from pathloom.operators import similarity as Q


def enet_objective(x, y, b0, b, alpha, l1):
    r = y - b0 - x @ b
    return (r @ r) / (2 * len(y)) + alpha * l1 * np.abs(b).sum() + alpha * (1 - l1) / 2 * (b @ b)


def test_elastic_net_is_optimal():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6)) * [1, 2, 3, 1, 1, 5] + 4
    y = x @ [1, 0, -1, 0, .5, 0] + rng.normal(size=200)
    z = np.column_stack([np.ones(200), x, y])
    s = Mo.Scaled(z.T @ z)
    xs = (x - x.mean(0)) / x.std(0)
    for alpha, l1 in ((0.01, 0.5), (0.3, 1.0), (1.0, 0.05)):
        b = Mo.elastic_net(s, alpha, l1)
        best = enet_objective(xs, y, y.mean(), b, alpha, l1)
        for _ in range(200):
            assert enet_objective(xs, y, y.mean(), b + rng.normal(size=6) * 1e-3, alpha, l1) >= best - 1e-12
        raw = s.raw(b)
        assert raw[0] + x @ raw[1:] == pytest.approx(y.mean() + xs @ b)
        assert Mo.sse(z.T @ z, raw) == pytest.approx(((y - raw[0] - x @ raw[1:]) ** 2).sum())


def test_grid_choice_prefers_larger_penalties():
    assert Mo.pick_best([(1.0, .1, .5), (1.0, .3, .1), (1.0 + 5e-13, .3, .5), (1.1, 1.0, 1.0)]) == (.3, .5)
    assert Mo.pick_best([(float("nan"), .1, .5), (2.0, .2, .5)]) == (.2, .5)


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(7)
    n = 600
    g = rng.integers(0, 30, n)
    x = rng.normal(size=(n, 3))
    y = x @ [1.0, -2.0, 0.0] + 0.5 * rng.normal(size=n)
    miss = rng.random(n) < 0.2
    rows = [(i, int(g[i]), None if miss[i] else float(x[i, 0]), float(x[i, 1]), float(x[i, 2]), float(y[i]))
            for i in range(n)]
    df = spark.createDataFrame(rows, "id long, grp int, a double, b double, c double, y double").repartition(5)
    sizes = df.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    outer = Fo.grouped_folds(sizes, "grp", 1, 5)
    assign = Mo.hashed_inner_folds(outer, "grp", 5, 5, "i").cache()
    x[miss, 0] = np.nan
    return df, assign, g, x, y


def test_nested_cv_equals_direct_computation(regression):
    df, assign, g, x, y = regression
    grid = dict(alphas=(0.01, 0.1), l1_ratios=(0.5, 1.0))
    fits = {r["outer_fold"]: r for r in Mo.elastic_net_cv(df, assign, "grp", ["a", "b", "c"], "y", **grid).collect()}
    assert sorted(fits) == [0, 1, 2, 3, 4]
    inner = {(r["outer_fold"], r["grp"]): r["inner"] for r in assign.collect()}

    def prepared(train, other):
        med = np.nanmedian(x[train], axis=0)
        f = np.where(np.isnan(x), med, x)
        m, s = f[train].mean(0), f[train].std(0)
        return (f[train] - m) / s, (f[other] - m) / s, med

    def solve(xt, yt, a, l):
        z = np.column_stack([np.ones(len(yt)), xt, yt])
        return Mo.elastic_net(Mo.Scaled(z.T @ z), a, l), yt.mean()

    for o, r in fits.items():
        lab = np.array([inner[o, k] for k in g])
        errs = {}
        for i in range(5):
            tr, va = (lab >= 0) & (lab != i), lab == i
            xt, xv, _ = prepared(tr, va)
            for a, l in itertools.product(*grid.values()):
                b, m = solve(xt, y[tr], a, l)
                errs.setdefault((a, l), []).append(math.sqrt(((y[va] - m - xv @ b) ** 2).mean()))
        best = min(errs, key=lambda k: np.mean(errs[k]))
        assert (r["alpha"], r["l1_ratio"]) == best
        assert r["inner_rmse"] == pytest.approx(np.mean(errs[best]), abs=1e-7)
        tr, te = lab >= 0, lab == -1
        xt, xe, med = prepared(tr, te)
        b, m = solve(xt, y[tr], *best)
        assert r["test_sse"] == pytest.approx(((y[te] - m - xe @ b) ** 2).sum(), rel=1e-7)
        assert r["fill"][0] == pytest.approx(med[0])


def test_predictions_match_the_reported_error(regression):
    df, assign, *_ = regression
    fits = Mo.elastic_net_cv(df, assign, "grp", ["a", "b", "c"], "y", alphas=(0.01,), l1_ratios=(0.5,)).cache()
    oof = Mo.predict_oof(df, assign, fits, "id", "grp", ["a", "b", "c"], "y")
    assert oof.count() == 600
    got = {r["outer_fold"]: r["s"] for r in oof.groupBy("outer_fold").agg(
        F.sum(F.pow(F.col("y_true") - F.col("y_pred"), 2)).alias("s")).collect()}
    for r in fits.collect():
        assert got[r["outer_fold"]] == pytest.approx(r["test_sse"], rel=1e-7)


def test_logistic_is_stationary_and_matches_spark_ml(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(3)
    n = 400
    x = rng.normal(size=(n, 2)) * [2, 0.5] + [1, -1]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [1, 2] + 0.5)))).astype(int)
    fold = rng.integers(0, 5, n)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                               "id long, a double, b double, y int").repartition(4)
    folds = spark.createDataFrame([(i, 0, int(f)) for i, f in enumerate(fold)], "id long, repeat int, fold int")
    fits = {r["fold"]: np.array(r["coef"]) for r in Mo.logistic_cv(df, folds, "id", "y", ["a", "b"]).collect()}
    k = 2
    tr = fold != k
    m, s = x[tr].mean(0), x[tr].std(0)
    z = (x[tr] - m) / s
    w = np.where(y[tr] == 1, tr.sum() / (2 * y[tr].sum()), tr.sum() / (2 * (1 - y[tr]).sum()))
    ml = LogisticRegression(regParam=1.0 / tr.sum(), weightCol="w", standardization=False, tol=1e-12,
                            maxIter=500).fit(spark.createDataFrame(
        [(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(z, y[tr], w)],
        ["features", "label", "w"]))
    b = ml.coefficients.toArray() / s
    assert fits[k][1:] == pytest.approx(b, abs=1e-5)
    assert fits[k][0] == pytest.approx(ml.intercept - b @ m, abs=1e-5)


def test_fold_schedule_equals_greedy():
    rng = np.random.default_rng(0)
    for trial in range(200):
        k = int(rng.integers(2, 6))
        sizes = sorted((int(v) for v in rng.integers(1, rng.integers(2, 30), rng.integers(1, 60))), reverse=True)
        load, want = [0] * k, {}
        for s in sizes:
            f = load.index(min(load))
            load[f] += s
            want.setdefault(s, []).append(f)
        runs = Fo.fill_schedule([(s, len(v)) for s, v in want.items()], k)
        got = {}
        for size, start, n, cycle in runs:
            assert len(got.setdefault(size, [])) == start
            got[size] += [cycle[i % len(cycle)] for i in range(n)]
        assert got == want
        assert len(runs) <= 40 * len(want) * k  # grows with distinct sizes, not with groups


def test_schedule_of_many_equal_groups_is_short():
    assert len(Fo.fill_schedule([(1, 10**12), (3, 10**9)], 5)) < 60


def test_grouped_folds_keep_groups_whole(spark):
    g = spark.range(300).select(F.col("id").alias("grp"), (1 + F.col("id") % 7).alias("size"))
    f = Fo.grouped_folds(g, "grp", 3, 5)
    assert f.count() == 900 and f.groupBy("repeat", "grp").count().where("count > 1").isEmpty()
    load = f.join(g, "grp").groupBy("repeat", "test_fold").agg(F.sum("size").alias("s")).collect()
    assert max(r["s"] for r in load) - min(r["s"] for r in load) <= 7
    a = f.where("repeat = 0").select("grp", "test_fold")
    assert not a.exceptAll(f.where("repeat = 1").select("grp", "test_fold")).isEmpty()


def test_matching_and_resampling(spark):
    df = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("c"),
                                 (F.col("id") % 4).alias("s"), (F.col("id") % 2).cast("int").alias("y"))
    m = C.stratified_match(df, "c", "A", "B", ["s"], "k", "t").groupBy("s").pivot("c", ["A", "B"]).count().collect()
    assert all(r["A"] == r["B"] for r in m) and len(m) == 4
    r = I.resample_counts(df, "k", "y", 4, "t").join(df.select("k", "y"), "k").groupBy("draw", "y").agg(
        F.sum("m").alias("n")).collect()
    assert len(r) == 8 and all(x["n"] == 250 for x in r)


def test_special_functions():
    # closed forms: t with 1 and 2 degrees of freedom, F with (2, d)
    for t in (0.1, 1.0, 3.5):
        assert Sp.t_two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t))
        assert Sp.t_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t))
        assert Sp.f_tail(t, 2, 8) == pytest.approx((1 + t / 4) ** -4)
    assert Sp.t_quantile(0.975, 1) == pytest.approx(12.7062047, abs=1e-6)


@pytest.mark.parametrize("n1,n2", [(2, 2), (2, 7), (3, 5)])
def test_exact_rank_sum_distribution(n1, n2):
    us = []
    for c in itertools.combinations(range(n1 + n2), n1):
        us.append(sum(c) + n1 - n1 * (n1 + 1) / 2)
    us = np.array(us)
    for u in range(n1 * n2 + 1):
        low = min(u, n1 * n2 - u)
        assert Q.mann_whitney_exact(n1, n2, u) == pytest.approx(min(1.0, 2 * (us <= low).mean()))


def test_label_enumeration(spark):
    lab = Q.labelings(spark, 11)
    assert lab.count() == 1980 and lab.distinct().count() == 1980
    assert Q.labelings(spark, 11, 2, 9).count() == 55
    v = [3.0, 3.1, 2.0, 2.1, 1, 1.1, .9, 1.05, .95, 1.2, .8]
    r = Q.exact_label_test(spark, v, [0, 0, 1, 1] + [2] * 7).first()
    assert r["n_perm"] == 1980 and r["n_extreme"] == 2  # the observed split and its mirror


def test_manova_and_pca_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 3)) @ rng.normal(size=(3, 3))
    g = np.repeat([0, 1, 2], 30)
    x[g == 1] += 0.5
    df = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(g, x)], "g int, a double, b double, c double")
    r = Q.manova(df, "g", ["a", "b", "c"])
    w = sum((x[g == k] - x[g == k].mean(0)).T @ (x[g == k] - x[g == k].mean(0)) for k in range(3))
    t = (x - x.mean(0)).T @ (x - x.mean(0))
    assert r["wilks"] == pytest.approx(np.linalg.det(w) / np.linalg.det(t))
    assert r["pillai"] == pytest.approx(np.trace((t - w) @ np.linalg.inv(t)))
    assert r["hotelling"] == pytest.approx(np.trace((t - w) @ np.linalg.inv(w)))
    _, ratio = Q.pca(df, ["a", "b", "c"])
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert ratio == pytest.approx(s / s.sum())


def test_ward_and_kmeans(spark):
    pts = [0.0, 0.1, 5.0, 5.2, 9.0]
    df = spark.createDataFrame([(i, [p]) for i, p in enumerate(pts)], "k int, v array<double>")
    merges = sorted(Q.ward(df, "k", "v").collect(), key=lambda r: r["height"])
    assert [(r["left_id"], r["right_id"]) for r in merges] == [(0, 1), (2, 3), (4, 6), (5, 7)]
    want, x = [], {i: [p] for i, p in enumerate(pts)}
    for step, r in enumerate(merges):  # Ward height from the clusters' means
        a, b = x[r["left_id"]], x[r["right_id"]]
        want.append((2 * len(a) * len(b) / (len(a) + len(b))) ** 0.5 * abs(np.mean(a) - np.mean(b)))
        x[len(pts) + step] = a + b
    assert [r["height"] for r in merges] == pytest.approx(want) and [r["size"] for r in merges] == [2, 2, 3, 5]
    coph = {frozenset((i, j)): next(r["height"] for s, r in enumerate(merges) if {pts[i], pts[j]} <= set(x[len(pts) + s]))
            for i in range(5) for j in range(i)}
    r = np.corrcoef([abs(pts[i] - pts[j]) for i in range(5) for j in range(i)],
                    [coph[frozenset((i, j))] for i in range(5) for j in range(i)])[0, 1]
    assert merges[0]["cophenetic_r"] == pytest.approx(r)
    lab = {r["k"]: r["cluster"] for r in Q.kmeans_targets(df, "k", "v", restarts=40).collect()}
    assert lab[0] == lab[1] and lab[2] == lab[3] and len(set(lab.values())) == 3


def test_kendall_with_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(0, 6)), float(rng.integers(0, 5))) for i in range(60)]
    s = [(np.sign(a[1] - b[1]), np.sign(a[2] - b[2])) for i, a in enumerate(rows) for b in rows[:i]]
    want = sum(p * q for p, q in s) / (sum(abs(p) for p, _ in s) * sum(abs(q) for _, q in s)) ** 0.5
    df = spark.createDataFrame(rows, "k int, x double, y double")
    assert Q.kendall(df, "k", "x", "y").first()["tau"] == pytest.approx(want)


def test_nearest_grid_equals_brute_force(spark):
    from pathloom.operators import geometry as Geo

    rng = np.random.default_rng(9)
    p = rng.normal(size=(300, 3)) * [1, 1, 10]
    p[:100] = p[0]  # a third of the points in one place
    c = rng.normal(size=(40, 3)) * [1, 1, 0.5]
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "v int, x double, y double, z double")
    cents = spark.createDataFrame([(f"c{i}", i, *map(float, r)) for i, r in enumerate(c)],
                                  "name string, ord int, x double, y double, z double")
    d = np.sqrt(((p[:, None] - c[None]) ** 2).sum(2)).argmin(1)
    for limit in (0, 1000):
        got = {r["v"]: r["name"] for r in Geo.nearest(points, cents, "v", "name", limit).collect()}
        assert got == {i: f"c{k}" for i, k in enumerate(d)}


def test_fold_medians_send_one_label_a_set_and_match_sorting(spark, monkeypatch):
    rng = np.random.default_rng(5)
    assign = [(r, o, g, -1 if (g + r) % 5 == o else int(rng.integers(0, 5))) for r in range(5) for o in range(5) for g in range(60)]
    x = [(int(rng.integers(0, 60)), None if rng.random() < 0.1 else float(rng.normal()) if rng.random() < 0.4 else float(rng.integers(-2, 3)))
         for _ in range(4000)]
    a = spark.createDataFrame(assign, "repeat int, outer_fold int, grp int, inner int")
    df = spark.createDataFrame([(g, v, None if g < 59 else 1.0) for g, v in x], "grp int, v double, rare double")
    sent, whole = [], Mo.side_table
    monkeypatch.setattr(Mo, "side_table", lambda t: sent.append(t) or whole(t))
    got = {tuple(r[:3]): (r["v"], r["rare"]) for r in Mo.fold_medians(df, a, "grp", ["v", "rare"], True).collect()}
    want = {}
    for r in range(5):
        for o in range(5):
            label = {g: i for q, p, g, i in assign if (q, p) == (r, o)}
            for left in range(-1, 5):
                keep = [(g, v) for g, v in x if label[g] >= 0 and label[g] != left]
                want[r, o, left] = (np.median([v for _, v in keep if v is not None]), 1.0 if any(g == 59 for g, _ in keep) else None)
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)
    def numbers(v):
        return sum(map(numbers, v)) if isinstance(v, (list, tuple)) else 1
    assert max(numbers(tuple(row)) for t in sent for row in t.collect()) <= 26  # the group and a label a set
