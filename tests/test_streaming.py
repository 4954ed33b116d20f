import numpy as np
from pathloom.operators import signals as Sg
from pathloom.streaming import detection as Dt

SCHEMA = "stim string, observed int, trial int, t double, value double"


def signal(seed, runs):
    rng = np.random.default_rng(seed)
    t = np.linspace(-300, 700, 201)
    rows = []
    for trial in runs:
        for obs in range(3):
            x = rng.normal(size=len(t))
            if (trial + obs) % 2:
                x[t == 50.0] = 40.0
            rows += [(f"s{trial % 2}", obs, trial, float(a), float(b)) for a, b in zip(t, x)]
    return rows


def test_incremental_detection_equals_batch(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    keys = ["stim", "observed", "trial"]
    every = []
    for i, runs in enumerate(([0, 1, 2], [3, 4])):
        rows = signal(i, runs)
        every += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        Dt.detect_arrivals(spark, src, SCHEMA, keys, out, state).awaitTermination()
    want = Sg.detect_events(spark.createDataFrame(every, SCHEMA), keys)
    got = Dt.detections(spark, out).drop("batch")
    assert got.count() == want.count() == 15
    assert got.select(*keys, "onset", "significant").exceptAll(
        want.select(*keys, "onset", "significant")).isEmpty()
    m = Dt.current_matrix(spark, out, "stim", "observed").collect()
    assert len(m) == 6
    for r in m:  # runs and channels of opposite parity respond
        hit = (int(r["stim"][1]) + r["observed"]) % 2 == 1
        assert r["probability"] == float(hit) and r["median_onset"] == (50.0 if hit else None)
