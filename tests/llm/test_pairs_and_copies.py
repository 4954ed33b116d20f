import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathloom.llm import exact_dedup, ngram_join
from pathloom.llm.components import components

from .conftest import DOCS, edge_rows


def brute_links(rows):
    """class and links of each row by comparing all sets of word 5-grams."""
    sets = [frozenset(ngram_join.ngram_hashes(t or "").tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-6):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        ids = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(ids) if ids else None
    return Counter((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def family(rng, n, members, edits):
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    for _ in range(members):
        own = list(words)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(n)] = "".join(rng.choice("stuvwxyz") for _ in range(5))
        yield " ".join(own)


def found(df):
    return Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in df.collect())


def test_join_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate([*family(rng, 80, 60, 3), *family(rng, 200, 12, 6), *family(rng, 6, 5, 1),
                                          *(" ".join(rng.choice("pqr") for _ in range(3)) for _ in range(30))])]
    rng.shuffle(rows)
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, "")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS)
    assert found(ngram_join.similarity_join(df)) == brute_links(rows)
    monkeypatch.setattr(ngram_join, "PAIR_BUCKET", 4)  # most buckets are cut into tiles now
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 9)
    assert found(ngram_join.similarity_join(df)) == brute_links(rows)


def test_join_on_edge_cases(edges, nothing):
    assert found(ngram_join.similarity_join(edges)) == brute_links(edge_rows())
    assert ngram_join.similarity_join(nothing).count() == 0


def test_bands_reach_their_recall():
    b = ngram_join.bands_for(0.8)
    assert 1 - (1 - 0.8 ** ngram_join.ROWS) ** b >= ngram_join.TARGET_RECALL
    rng = random.Random(2)
    texts = [*family(rng, 300, 2, 0), *family(rng, 300, 2, 60)]
    s = [ngram_join.band_hashes(ngram_join.ngram_hashes(t), b) for t in texts]
    assert (s[0] == s[1]).all() and not (s[0] == s[2]).any()


def test_components_of_chains_and_stars(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)]
    star = [("z", f"y{i}") for i in range(50)] + [("y3", "y3"), ("y1", "z")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star, "a string, b string")).collect()}
    assert got == {f"{i:03d}": "000" for i in range(1, 41)} | {f"y{i}": "y0" for i in range(1, 50)} | {"z": "y0"}


def brute_copies(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = Counter()
    for d, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out[d, keep, len(groups[t or ""]), d == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    return out


def test_dedup_equals_brute_force(edges, nothing, documents):
    rows = Counter(map(tuple, exact_dedup.dedup(edges).collect()))
    assert rows == brute_copies(edge_rows())
    assert exact_dedup.dedup(nothing).count() == 0
    own = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert Counter(map(tuple, exact_dedup.dedup(documents).collect())) == brute_copies(own)


def test_state_lives_on_between_calls(spark, tmp_path):
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "a"), (4, "c")], "doc_id long, text string")
    state = exact_dedup.DedupState(spark, str(tmp_path))
    state.add(first)
    assert {r["rows"] for r in state.keys().collect()} == {1}
    state.add(second)
    keys = {r["place"]["doc_id"]: (r["rows"], r["place"]["n_bytes"]) for r in state.keys().collect()}
    assert keys == {3: (2, 1), 2: (1, 1), 4: (1, 1)}


def test_a_digest_shared_by_two_texts_is_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest", lambda text="text": F.unhex(F.sha2(F.substring(text, 1, 1), 256)))
    df = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "ab"), (4, "b")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(df).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


@pytest.mark.parametrize("name", ["op8_exact_dedup", "op9_url_filters"])
def test_sql_oracles(spark, name):
    import duckdb

    from pathloom.llm import load_all

    queries, oracles = load_all()
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as from '{sf}/{t}.parquet'")
    want = con.sql(oracles[name])
    df = queries[name](spark, sf)
    assert set(df.columns) == set(want.columns)
    assert Counter(map(tuple, df.select(*want.columns).collect())) == Counter(want.fetchall())
