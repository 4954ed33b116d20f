"""The distributed scan and quantiles against plain NumPy, both small and forced large paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import ordered as O


@pytest.fixture(params=["plain", "distributed"])
def mode(request, monkeypatch):
    if request.param == "distributed":
        monkeypatch.setattr(O, "SMALL", 10)
    return request.param


def frame(spark, n=3000, hot=0.4):
    """Two thirds of the rows in other groups, one hot group, many ties."""
    rng = np.random.default_rng(3)
    g = np.where(rng.random(n) < hot, 0, rng.integers(1, 8, n))
    v = rng.integers(0, 200, n).astype(float)
    return g, v, spark.createDataFrame(
        [(int(i), int(a), float(b)) for i, (a, b) in enumerate(zip(g, v))],
        "id long, g int, v double").repartition(6)


def test_running_sum_and_position(spark, mode):
    g, v, df = frame(spark)
    out = O.scan(df, ["g"], ["v", "id"], {
        "run": ("sum", F.col("v")), "top": ("max", F.col("id"))}).collect()
    assert len(out) == len(g)
    by = {}
    for r in sorted(out, key=lambda r: (r["g"], r["v"], r["id"])):
        s, m = by.get(r["g"], (0.0, -1))
        s, m = s + r["v"], max(m, r["id"])
        by[r["g"]] = (s, m)
        assert r["run"] == s and r["top"] == m
    pos = O.row_position(df, [], ["v", "id"]).orderBy("pos").collect()
    assert [r["pos"] for r in pos] == list(range(1, len(g) + 1))


def test_average_ranks(spark, mode):
    g, v, df = frame(spark, 800)
    for r in O.value_ranks(df, ["g"], "v").collect():
        mine = v[g == r["g"]]
        assert r["n_before"] == (mine < r["v"]).sum()
        assert r["avg_rank"] == (mine < r["v"]).sum() + ((mine == r["v"]).sum() + 1) / 2


QS = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.75, "e": 1.0}


def test_exact_quantiles(spark, mode):
    g, v, df = frame(spark)
    for r in O.exact_quantiles(df, ["g"], "v", QS).collect():
        for n, q in QS.items():
            assert r[n] == pytest.approx(np.percentile(v[g == r["g"]], 100 * q), abs=1e-12)


@pytest.mark.parametrize("bracket", [50, 1000])
def test_exact_quantiles_beyond_the_sketch(spark, monkeypatch, bracket):
    monkeypatch.setattr(O, "SMALL", 10)
    monkeypatch.setattr(O, "BRACKET", bracket)
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=6000), np.zeros(3000)])  # a third of the rows share a value
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(5)
    r = O.exact_quantiles(df, [], "v", QS).first()
    for n, q in QS.items():
        assert r[n] == pytest.approx(np.percentile(v, 100 * q), abs=1e-12)


def test_null_keys_are_a_group(spark, monkeypatch):
    rows = [(None if i % 3 == 0 else i % 3, i, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i int, x double")
    want = {}
    for k, i, x in rows:
        want[i] = sum(r[2] for r in rows if r[0] == k and r[1] <= i)
    for small in (1000, 0):
        monkeypatch.setattr(O, "SMALL", small)
        got = O.scan(df, ["k"], ["i"], {"s": ("sum", F.col("x"))}).collect()
        assert {r["i"]: r["s"] for r in got} == want
