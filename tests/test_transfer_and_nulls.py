import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import special
from pathloom.operators import commetrics, conditional, models, nulls, resampling, similarity, transfer


def test_draws_from_counts(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 7)  # many blocks
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.normal(y * 0.8, 1.0), 1)
    rows = [("m", int(a), float(b)) for a, b in zip(y, s)]
    rows += [("apart", i % 2, float(i % 2)) for i in range(50)] + [("tied", i % 2, 1.0) for i in range(50)] + [("one class", 1, 0.5)]
    df = spark.createDataFrame(rows, "model string, y int, s double")
    d = resampling.auc_draws(df, "y", "s", 400, "t", ["model"])
    got = {r.model: r for r in resampling.intervals(d, ["model"]).collect()}
    assert set(got) == {"m", "apart", "tied"}
    assert got["apart"].ci_low == got["apart"].ci_high == 1.0 and got["tied"].mean == 0.5
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)
    sd = np.sqrt(wins.mean(1).var(ddof=1) / len(pos) + wins.mean(0).var(ddof=1) / len(neg))
    assert abs(got["m"].mean - wins.mean()) < 4 * sd / 20 and abs(got["m"].sd / sd - 1) < 0.2
    again = resampling.auc_draws(df.repartition(5), "y", "s", 400, "t", ["model"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, d.collect()))


def test_exchanges_keep_degrees(spark):
    rng = random.Random(3)
    edges = {(g, *sorted(rng.sample(range(20), 2))) for g in "ab" for _ in range(60)}
    df = spark.createDataFrame([*edges, ("c", 1, 2)], "g string, a int, b int")
    out = [tuple(r) for r in nulls.exchange_rounds(df, "g", "t", per_edge=1).select("g", "a", "b").collect()]
    assert len(out) == len(set(out)) == len(edges) + 1 and all(a < b for _, a, b in out)
    degrees = lambda es: Counter((g, n) for g, a, b in es for n in (a, b))
    assert degrees(out) == degrees([*edges, ("c", 1, 2)])
    assert len(set(out) - edges) > 40 and ("c", 1, 2) in out


def test_transfer_fits_are_optimal(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "x" if i % 3 else "z", float(v), float(w), int(v + 0.5 * w + rng.normal() > 0), 1.0)
            for i, (v, w) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "id long, dom string, v double, w double, y int, const double")
    roles = transfer.transfer_roles(df, "id", "dom", ("x", "z"), 2, "t")
    n = Counter((r.direction, r.variant, r.repeat, r.role) for r in roles.collect())
    assert n["x_to_z", "OOS", 0, "train_source"] == 160 and n["x_to_z", "OOS", 0, "test_target"] == 50
    assert n["z_to_x", "LETTER", 1, "train_source"] == 100 and n["z_to_x", "LETTER", 1, "test_source"] == 0
    features, of = ["v", "w", "const"], {"A": ["v"], "B": ["v", "w", "const"]}
    fits, scored = transfer.transfer_fits(df, roles, "id", "y", features, of)
    g = transfer.gradient_check(df, scored, fits, "id", features, of).collect()
    assert len(g) == 16 and all(r.converged and r.gradient < 1e-6 for r in g)
    worse = fits.withColumn("coef", F.transform("coef", lambda c: c * 1.1))
    assert all(r.gradient > 1e-3 for r in transfer.gradient_check(df, scored, worse, "id", features, of).where("model = 'B'").collect())


def test_transfer_needs_both_classes(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else "z", float(i), 1) for i in range(20)], "id long, dom string, v double, y int")
    roles = transfer.transfer_roles(df, "id", "dom", ("x", "z"), 1, "t")
    with pytest.raises(ValueError, match="lacks one of the classes"):
        transfer.transfer_fits(df, roles, "id", "y", ["v"], {"A": ["v"]})


def test_conditional_fits_are_minima(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    rows = [(i, i % 20, *(None if (i + k) % 17 == 0 and k == 1 else float(v) for k, v in enumerate(r)), float(r[0] - r[2] + rng.normal()))
            for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "sample_id long, grp long, a double, b double, c double, y double")
    folds = spark.createDataFrame([(g, r, (g + r) % 5) for g in range(20) for r in range(2)], "grp long, repeat int, test_fold int")
    assign = models.hashed_inner_folds(folds, "grp", 3, 5, "i")
    fits = conditional.conditional_fits(df, assign, "grp", "y", ("base", ["a"]), {"more": ["a", "b", "c"]})
    chosen = {(r.arm, r.repeat, r.outer_fold): (r.alpha, r.l1_ratio) for r in fits.collect()}
    assert len(chosen) == 20 and all(chosen["more", *k[1:]] == v for k, v in chosen.items())
    for arm, columns in (("base", ["a"]), ("more", ["a", "b", "c"])):
        own = fits.where(F.col("arm") == arm)
        v = conditional.elastic_net_violations(df, assign, own, "grp", columns, "y").collect()
        assert len(v) == 10 and all(r.violation < 1e-6 and r.n_train == 160 for r in v)
    worse = fits.where("arm = 'more'").withColumn("coef", F.transform("coef", lambda c: c * 1.05))
    assert all(r.violation > 1e-3 for r in conditional.elastic_net_violations(df, assign, worse, "grp", ["a", "b", "c"], "y").collect())


def test_kendall_by_bits(spark):
    rng = random.Random(7)
    for top in (1, 3, 40):
        rows = [(i, rng.randint(0, top), rng.randint(0, top)) for i in range(90)]
        sign = lambda v: (v > 0) - (v < 0)
        pairs = [(sign(a[1] - b[1]), sign(a[2] - b[2])) for i, a in enumerate(rows) for b in rows[:i]]
        tau = sum(p * q for p, q in pairs) / (sum(abs(p) for p, _ in pairs) * sum(abs(q) for _, q in pairs)) ** 0.5
        got = similarity.kendall(spark.createDataFrame(rows, "k long, x int, y int"), "k", "x", "y").first()["tau"]
        assert got == pytest.approx(tau, abs=1e-12)


def test_p_values(spark):
    a, b = [1.0, 2.0, 4.0, 4.0, 7.0], [3.0, 4.0, 8.0, 9.0, 10.0, 12.0]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    r = similarity.two_group_stats(df, "g", "a", "b", "v").first()
    assert r.welch_p == pytest.approx(special.t_two_sided(r.welch_t, r.welch_df), abs=1e-12) and 0.02 < r.welch_p < 0.06
    ties, n = sum(c ** 3 - c for c in Counter(a + b).values()), len(a) + len(b)
    z = (abs(r.u - 15) - 0.5) / (30 / 12 * (n + 1 - ties / (n * (n - 1)))) ** 0.5
    draws = np.random.default_rng(0).normal(size=400_000)
    assert r.u_p == pytest.approx((np.abs(draws) > z).mean(), abs=0.005)
    f = similarity.anova(df, "g", "v").first()
    assert f.p == pytest.approx(special.f_tail(f.f, 1, 9), abs=1e-12)


def test_whole_communicability(spark):
    w = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0), (1, 2, 1.0)], "u int, v int, x double")
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node int")
    got = {(r.u, r.v): r.x for r in commetrics.communicability(w, nodes=nodes).collect()}
    m = np.zeros((5, 5))
    strength = {0: 2.0, 1: 3.0}
    for u, v, x in ((0, 1, 2.0), (1, 0, 2.0), (1, 2, 1.0)):
        m[u, v] = x / (strength.get(u, 1.0) * strength.get(v, 1.0)) ** 0.5
    total, power = np.eye(5), np.eye(5)
    for k in range(1, 21):
        power = power @ m / k
        total = total + power
    assert len(got) == 25 and all(got[i, j] == pytest.approx(total[i, j], abs=1e-12) for i in range(5) for j in range(5))
