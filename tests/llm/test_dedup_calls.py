"""Deduplication over several calls on one folder, against brute force."""

from collections import Counter

from pyspark.sql import functions as F

from pathloom.llm import exact_dedup

from .conftest import edge_rows
from .test_pairs_and_copies import brute_copies


def calls(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    rows = [[(50, "x"), (1, "only once"), (2, "twice"), (3, "twice")], [(10, "x"), (4, "new"), (60, "twice"), (None, "n")],
            edge_rows(), [*edge_rows()[:6], (70, "x")]]
    return rows, [frame(r) for r in rows]


def brute_later(rows, k):
    """The verdicts of call k's rows against all that came."""
    every = brute_copies([r for c in rows[:k + 1] for r in c])
    verdict = {(d, sha): rest for (d, *rest, sha) in every}
    own = Counter((d, sha) for (d, *_, sha), n in brute_copies(rows[k]).items() for _ in range(n))
    return Counter({(d, *verdict[d, sha], sha): n for (d, sha), n in own.items()})


def test_dedup_over_several_calls(spark, tmp_path):
    rows, frames = calls(spark)
    for k, df in enumerate(frames):
        got = Counter(map(tuple, exact_dedup.dedup(df, str(tmp_path)).collect()))
        assert got == brute_later(rows, k)


def test_a_hit_on_an_earlier_call_is_checked_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest", lambda text="text": F.unhex(F.sha2(F.substring(text, 1, 1), 256)))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    exact_dedup.dedup(frame([(9, "ab"), (8, "ac")]), str(tmp_path)).collect()
    got = exact_dedup.dedup(frame([(3, "ab"), (4, "ad"), (5, "b")]), str(tmp_path)).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {3: (9, 2), 4: (4, 1), 5: (5, 1)}
