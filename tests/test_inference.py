"""Behaviour of the paired tests on a tiny synthetic pair of arms."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import inference as I
from pathloom.operators import metrics as Me
from pathloom.operators import validation as V

SAMPLES = {"a0": 0.0, "a1": 0.3, "b0": 0.7, "b1": 1.0}
OOF = "sample_id string, repeat int, outer_fold int, y_true double, y_pred double"


def rows():
    a, b = [], []
    for rep in (0, 1):
        for s, y in SAMPLES.items():
            fold = int(s[0] == "b")
            a.append((s, rep, fold, y, y + (0.04 if rep == 0 else -0.03)))
            b.append((s, rep, fold, y, y + (0.20 if s[0] == "a" else -0.14)))
    return a, b, [(s, s[0].upper()) for s in SAMPLES]


@pytest.fixture(scope="module")
def arms(spark):
    a, b, m = rows()
    return (spark.createDataFrame(a, OOF), spark.createDataFrame(b, OOF),
            spark.createDataFrame(m, "sample_id string, seed string"))


def exchange_delta(a, b, unit, flips):
    """Row by row: swap the arms of flipped units, difference of mean R2."""
    out = []
    for rep in (0, 1):
        ra = [r for r in a if r[1] == rep]
        rb = [r for r in b if r[1] == rep]
        y = np.array([r[3] for r in ra])
        swap = np.array([flips[unit(r[0])] for r in ra])
        pa, pb = np.array([r[4] for r in ra]), np.array([r[4] for r in rb])
        qa, qb = np.where(swap, pb, pa), np.where(swap, pa, pb)
        sst = ((y - y.mean()) ** 2).sum()
        out.append((((y - qb) ** 2).sum() - ((y - qa) ** 2).sum()) / sst)
    return np.mean(out)


@pytest.mark.parametrize("column,unit", [("seed", lambda s: s[0].upper()), ("sample_id", lambda s: s)])
def test_contributions_equal_row_exchange(spark, arms, column, unit):
    a, b, _ = rows()
    paired = V.prepare_pair(*arms)
    d = {r[column]: r["d"] for r in I.unit_contributions(paired, column).collect()}
    for mask in itertools.product([False, True], repeat=len(d)):
        flips = dict(zip(sorted(d), mask))
        fast = sum(-d[u] if flips[u] else d[u] for u in d)
        assert fast == pytest.approx(exchange_delta(a, b, unit, flips), abs=1e-12)


def test_sum_of_contributions_is_the_difference(arms):
    paired = V.prepare_pair(*arms)
    total = I.unit_contributions(paired, "seed").agg(F.sum("d")).first()[0]
    long = arms[0].withColumn("arm", F.lit("A")).unionByName(arms[1].withColumn("arm", F.lit("B")))
    r = {x["arm"]: x["r2"] for x in Me.repeat_r2(long, ["arm"]).collect()}
    assert total == pytest.approx(r["A"] - r["B"], abs=1e-12)


def test_signs_are_balanced_and_repeatable(spark):
    u = spark.createDataFrame([(f"u{i}", 1.0) for i in range(40)], "unit string, d double")
    s = I.sign_bits(u, "unit", 300, "tag")
    assert s.count() == 40 * 300
    assert s.groupBy("unit", "draw").count().where("count > 1").isEmpty()
    mean = s.agg(F.avg("sign")).first()[0]
    assert abs(mean) < 0.05
    again = I.sign_bits(u.repartition(7), "unit", 300, "tag")
    assert s.exceptAll(again).isEmpty()
    other = I.sign_bits(u, "unit", 300, "other")
    assert not s.exceptAll(other).isEmpty()


def test_signflip_tails_and_repeatability(arms):
    c = I.unit_contributions(V.prepare_pair(*arms), "sample_id")
    r = I.signflip(c, "sample_id", 500, "t").first()
    assert r == I.signflip(c, "sample_id", 500, "t").first()
    assert r["lower_tail"] + r["upper_tail"] >= 500
    assert r["p_two_sided"] == min(1.0, 2 * min(r["lower_tail"], r["upper_tail"]) / 500)
    assert r["p_two_sided_plus1"] == pytest.approx(
        min(1.0, 2 * (min(r["lower_tail"], r["upper_tail"]) + 1) / 501))


def test_identical_arms(arms):
    a, _, m = arms
    r = I.signflip(I.unit_contributions(V.prepare_pair(a, a, m), "seed"), "seed", 50, "t").first()
    assert (r["observed"], r["lower_tail"], r["upper_tail"], r["p_two_sided"]) == (0.0, 50, 50, 1.0)


def test_formats_agree(spark, arms):
    a, b, _ = arms
    wide = a.withColumnRenamed("y_pred", "c8r_pred").join(
        b.select(*V.KEY, F.col("y_pred").alias("c4_pred")), V.KEY)
    wa, wb = V.wide_arms(wide)
    long = a.withColumn("arm", F.lit("X")).unionByName(b.withColumn("arm", F.lit("Y")))
    la, lb = V.labelled_arms(long, "X", "Y")
    for p, q in ((wa, a), (wb, b), (la, a), (lb, b)):
        assert p.select(*q.columns).exceptAll(q).isEmpty() and p.count() == q.count()
    with pytest.raises(ValueError):
        V.labelled_arms(long, "X", "Z")


def _with(spark, change):
    a, b, m = rows()
    a, b, m = change(a, b, m)
    return (spark.createDataFrame(a, OOF), spark.createDataFrame(b, OOF),
            spark.createDataFrame(m, "sample_id string, seed string"))


BAD = {
    "duplicate row": lambda a, b, m: (a + a[:1], b, m),
    "missing row": lambda a, b, m: (a, b[1:], m),
    "incomplete support": lambda a, b, m: (a[1:], b[1:], m),
    "fold mismatch": lambda a, b, m: (a, [(*b[0][:2], 3, *b[0][3:]), *b[1:]], m),
    "outcome mismatch": lambda a, b, m: (a, [(*b[0][:3], 9.0, b[0][4]), *b[1:]], m),
    "outcome changes": lambda a, b, m: ([(*a[0][:3], 9.0, a[0][4]), *a[1:]],
                                        [(*b[0][:3], 9.0, b[0][4]), *b[1:]], m),
    "duplicate map row": lambda a, b, m: (a, b, m + m[:1]),
    "missing map row": lambda a, b, m: (a, b, m[1:]),
    "empty seed": lambda a, b, m: (a, b, [(m[0][0], " "), *m[1:]]),
    "seed in two folds": lambda a, b, m: ([(s, r, 5 if s == "a0" else f, y, p) for s, r, f, y, p in a],
                                          [(s, r, 5 if s == "a0" else f, y, p) for s, r, f, y, p in b], m),
    "not finite": lambda a, b, m: ([(*a[0][:4], float("nan")), *a[1:]], b, m),
}


@pytest.mark.parametrize("name", BAD)
def test_bad_pairs_are_refused(spark, name):
    with pytest.raises(ValueError):
        V.prepare_pair(*_with(spark, BAD[name]))


def test_multiplicity(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([("f", str(i), x) for i, x in enumerate(p)], "fam string, k string, p double")
    h = {r["k"]: r["p_holm"] for r in I.holm(df, ["fam"], "p", "k").collect()}
    assert [h[str(i)] for i in range(4)] == pytest.approx([0.03, 0.06, 0.06, 0.02])
    q = {r["k"]: r["q_bh"] for r in I.benjamini_hochberg(df, ["fam"], "p", "k").collect()}
    assert [q[str(i)] for i in range(4)] == pytest.approx([0.02, 0.04, 0.04, 0.02])


def test_auc_counts_pairs(spark):
    rng = np.random.default_rng(2)
    s, y = rng.integers(0, 20, 300).astype(float), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean())
    assert I.auc(df, [], "y", "s").first()["auc"] == pytest.approx(want, abs=1e-12)


def test_bootstrap_is_paired_and_centred(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(200):
        y = float(rng.normal())
        for rep in (0, 1):
            data.append((f"s{i}", f"c{i % 20}", rep, 0, y, y + 0.3 * float(rng.normal()), "A"))
            data.append((f"s{i}", f"c{i % 20}", rep, 0, y, y + 0.6 * float(rng.normal()), "B"))
    df = spark.createDataFrame(data, "sample_id string, seed string, repeat int, outer_fold int, "
                                     "y_true double, y_pred double, arm string")
    boot = I.cluster_bootstrap(df, "seed", 200, "b")
    assert boot.count() == 400
    s = I.bootstrap_summary(I.paired_delta(boot, "A", "B")).first()
    r = {x["arm"]: x["r2"] for x in Me.repeat_r2(df, ["arm"]).collect()}
    assert s["ci_low"] < r["A"] - r["B"] < s["ci_high"] and s["n_effective"] == 200
    same = I.paired_delta(I.cluster_bootstrap(
        df.withColumn("y_pred", F.col("y_true") + 0.1), "seed", 20, "b"), "A", "B")
    assert same.where("delta <> 0").isEmpty()


def test_bootstraps_keep_picks_in_their_task_and_match_joined_picks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(k, int(k % 3 == 0), m, None if rng.random() < 0.1 else float(rng.randrange(12)))
            for k in range(150) for m in ("a", "b", None) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "k int, y int, model string, score double")
    packed = I.auc_bootstrap(df, "k", "y", 30, "t", ["model"])
    diff = I.mean_difference_bootstrap(df.where("model = 'a'"), "k", "y", "score", 30, "t")
    for frame in (packed, diff):
        assert "hashpartitioning(draw" not in frame._jdf.queryExecution().toString()
    joined = I.joined_auc_bootstrap(df, "k", "y", 30, "t", ["model"])
    rows_of = lambda f: {(r["model"], r["draw"]): r["auc"] for r in f.collect()}
    got, want = rows_of(packed), rows_of(joined)
    assert got.keys() == want.keys() and len(want) == 90 and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    small = {r["draw"]: r["delta"] for r in diff.collect()}
    monkeypatch.setattr(I, "PACKED", 0)
    large = {r["draw"]: r["delta"] for r in I.mean_difference_bootstrap(
        df.where("model = 'a'"), "k", "y", "score", 30, "t").collect()}
    assert len(large) == 30 and all(abs(small[d] - large[d]) < 1e-12 for d in large)


def test_mean_differences_are_made_of_hashes_in_the_jvm(spark):
    import hashlib

    lanes = 1024  # of MeanDifferences.java
    rows = [(k, 0 if k < 2 * lanes + 30 else 1 if k < 2 * lanes + 500 else 2 if k % 2 else None,
             None if k % 7 == 0 else float(k % 101)) for k in range(2 * lanes + 600)]
    df = spark.createDataFrame(rows, "k int, y int, x double").repartition(5)
    of = {c: [x for _, y, x in rows if y == c] for c in (0, 1)}
    for tag in ("t", "t" * 43, "t" * 44, "t" * 45, "t" * 46, "ü" * 70):  # a message fills a block, or more
        frame = I.mean_difference_bootstrap(df, "k", "y", "x", 12, tag)
        assert "MapInPandas" not in frame._jdf.queryExecution().toString()  # no pick is made in Python
        got = {r["draw"]: r["delta"] for r in frame.collect()}
        assert sorted(got) == list(range(12))
        for draw in (0, 9, 10, 11):
            mean = {c: sum(x[int(hashlib.sha256(f"{tag}|{draw}|{c}|{i}".encode()).hexdigest()[:13], 16) % len(x)] or 0.0
                           for i in range(len(x))) / len(x) for c, x in of.items()}
            assert abs(got[draw] - (mean[1] - mean[0])) < 1e-9


def test_mean_differences_without_values_are_null(spark):
    deltas = lambda rows: [r["delta"] for r in I.mean_difference_bootstrap(
        spark.createDataFrame(rows, "k int, y int, x double"), "k", "y", "x", 3, "t").collect()]
    assert deltas([(1, 0, 2.0), (2, 1, 5.0), (3, None, 9.0), (4, 7, 9.0)]) == [3.0] * 3
    assert deltas([(1, 0, 2.0), (2, 1, None)]) == deltas([(1, 0, 2.0)]) == deltas([(1, 7, 2.0)]) == [None] * 3
    assert deltas([(1, 0, 2.0), (2, 1, float("nan"))]) == [None] * 3
    assert deltas([(1, None, 2.0)]) == []


def test_slot_picks_are_the_hashes_across_blocks():
    import hashlib

    n = I.SLOTS + 1_500
    got = [int(x) for part in I.slot_picks("t", 7, "1", n) for x in part]
    for slot in (0, 9, I.SLOTS - 1, I.SLOTS, I.SLOTS + 1, n - 1):
        assert got[slot] == int(hashlib.sha256(f"t|7|1|{slot}".encode()).hexdigest()[:13], 16) % n
    assert len(got) == n


def test_samples_spread_over_more_tasks_as_orders_grow(spark, monkeypatch):
    from pathloom.plans import inference_queries as iq

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(iq, "ORDERS_A_TASK", 50)
    tasks = spark.read.parquet(f"{sf}/orders.parquet").count() // 50
    for name in ("oof_pivot", "pooled_arm"):
        df = getattr(iq, name)(spark, sf)
        assert df.rdd.getNumPartitions() == tasks > 8
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(sample_id" not in plan  # groups find their rows together
    read = []
    whole = iq.materialize
    monkeypatch.setattr(iq, "materialize", lambda df: read.append(df.count()) or whole(df))
    iq.contrasts_by_length(spark, sf)
    assert read == [iq.samples(spark, sf).count()]  # not ten rows an order


def test_enrichment_reads_the_shipments_once(spark, monkeypatch):
    from pathloom.plans import inference_queries as iq

    built, whole = [], iq.fx.edges
    monkeypatch.setattr(iq.fx, "edges", lambda *a: built.append(a) or whole(*a))
    monkeypatch.setattr(iq.I, "enrichment", lambda *a: spark.createDataFrame(
        [], "circuit int, n_paths long, observed double, null_mean double, ratio double, p double"))
    iq.enrichment(spark, "/root/testdata/sf0.001")
    assert len(built) == 1
