from itertools import combinations

import numpy as np
import pytest

from pathloom.operators import nulls, permutation


def ways(n, first, second):
    for a in combinations(range(n), first):
        rest = [i for i in range(n) if i not in a]
        for b in combinations(rest, second):
            yield [0 if i in a else 1 if i in b else 2 for i in range(n)]


def test_exact_tests_against_enumeration(spark):
    rng = np.random.default_rng(4)
    cls = [0, 0, 1, 1, 2, 2, 2]
    x = rng.normal(size=(7, 3)) + np.array(cls)[:, None] + 1e6  # a large mean must not cancel
    df = spark.createDataFrame([(i, c, [float(v) for v in r]) for i, (c, r) in enumerate(zip(cls, x))] + [(99, None, None)],
                               "k int, cls int, vec array<double>")

    def pseudo_f(c):
        c = np.array(c)
        b = sum((c == g).sum() * ((x[c == g].mean(0) - x.mean(0)) ** 2).sum() for g in range(3))
        w = sum(((x[c == g] - x[c == g].mean(0)) ** 2).sum() for g in range(3))
        return (b / 2) / (w / 4)

    fs = [pseudo_f(c) for c in ways(7, 2, 2)]
    r = permutation.permanova_exact(df, "k", "cls", "vec").collect()
    assert len(r) == 1 and r[0].n_perm == len(fs) == 210
    assert abs(r[0].pseudo_f - pseudo_f(cls)) < 1e-6 and r[0].n_extreme == sum(f >= pseudo_f(cls) - 1e-7 for f in fs)
    got = {(r.i, r.a, r.b): r for r in permutation.contrast_exact(df, "k", "cls", "vec", [(0, 1), (0, 2)]).collect()}
    assert len(got) == 6
    for (i, a, b), r in got.items():
        diff = lambda c: x[np.array(c) == a, i].mean() - x[np.array(c) == b, i].mean()
        assert abs(r.stat_obs - diff(cls)) < 1e-8
        assert r.n_extreme == sum(abs(diff(c)) >= abs(diff(cls)) - 1e-8 for c in ways(7, 2, 2))


def test_exact_tests_refuse_what_they_cannot_enumerate(spark):
    row = lambda i, c: (i, c, [float(i)])
    schema = "k int, cls int, vec array<double>"
    for rows in ([row(i, i % 3) for i in range(17)], [row(0, 0), row(1, 1)], [row(0, 0), row(0, 1), row(1, 2)], []):
        with pytest.raises(ValueError):
            permutation.labeling_sums(spark.createDataFrame(rows, schema), "k", "cls", "vec")


def test_match_findings(spark):
    t = spark.createDataFrame([("c", f"t{i}", float(v)) for i, v in enumerate([1, 2, 3, 3])], "cell string, path_key string, mean_w double")
    p = spark.createDataFrame([("c", f"p{i}", float(v)) for i, v in enumerate([3.1, 0.9, 2.2, 9.0, 2.9])] + [("d", "q", 1.0)],
                              "cell string, path_key string, mean_w double")
    pairs = nulls.match_greedy(t, p, ["cell"])
    count = lambda m: {r.finding: r.n for r in nulls.match_findings(m, t, p, ["cell"]).collect()}
    assert set(count(pairs).values()) == {0}
    wrong = spark.createDataFrame([("c", "t0", "p3", 8.0), ("c", "t1", "p3", 7.0), ("c", "t2", "zz", 0.0)], pairs.schema)
    assert count(wrong) == {"unmatched target": 1, "pool path used twice": 1, "not in the pool": 1, "nearer path was free": 8}
