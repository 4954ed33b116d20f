"""Matched walks go on until a cell has its walks or its tries are used up."""

from pyspark.sql import functions as F

from pathloom.operators import nulls as N
from pathloom.session import materialize


def test_walks_until_found_or_bound(spark):
    # 0 reaches 1..5, each of which reaches the others; only the walks through 0-1 are long
    pairs = [(0, v, 100.0 if v == 1 else 1.0, True) for v in range(1, 6)]
    pairs += [(u, v, 1.0, True) for u in range(1, 6) for v in range(1, 6) if u != v]
    e = materialize(spark.createDataFrame(pairs, "u int, v int, tract double, mask boolean"))
    cells = materialize(spark.createDataFrame(
        [(0, 2, 2, 101.0, 300), (0, 3, 2, 1e6, 7), (0, 4, 2, 2.0, 1)],
        "seed int, endpoint int, L int, med_len double, n_paths long"))
    walks = materialize(N.matched_walks(cells, e, 13, "t"))
    rows = N.with_shortfall(cells, walks).collect()
    n = {end: sum(r["endpoint"] == end and r["nodes"] is not None for r in rows) for end in (2, 3, 4)}
    assert n == {2: 300, 3: 0, 4: 1}  # a fifth of the tries of the first end inside its band
    assert {r["endpoint"]: r["shortfall"] for r in rows} == {2: 0, 3: 7, 4: 0}
    assert all(r["nodes"][:2] == [0, 1] for r in rows if r["endpoint"] == 2)
    tries = [r["t"] for r in rows if r["endpoint"] == 2]
    assert len(set(tries)) == 300 and max(tries) < 60_000
    few = N.matched_walks(cells, e, 13, "t", 64).where("endpoint = 2").select("t", "nodes").collect()
    first = walks.where(F.col("endpoint") == 2).where("t < 64").select("t", "nodes").collect()
    assert 0 < len(few) < 64 and sorted(few) == sorted(first)  # a try is the same in every round
