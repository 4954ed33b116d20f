import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest

from pathloom.llm import filter_audit, periodic_runs, sentence_pieces

from .conftest import DOCS, edge_rows

MODEL = public_tokenizers.path(sentence_pieces.VOCABULARY)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- filter audit


def masks(rows):
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        out.append([len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                    bool(re.search(r"[#$%&*|]", t)), d is not None and d > least[t]])
    return out


def slow_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    marks = masks(rows)
    out = {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(r[0], dict(zip("ABCDE", m))) for r, m in zip(rows, marks) if (r[2] or "") == part]
        shares = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                fails = sum(r[1][x] for r in mine)
                shares[x] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), fails - len(gone), sum(sum(r[1].values()) == 1 for r in mine if r[1][x]),
                    sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shares[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows(rng, ids):
    texts = ["a " * 250, "", None, "some plain words " * 5, "UPPER lower " * 120, "50 % off", " ".join(map(str, range(300))),
             "x" * 50_000, " ".join(f"w{i}" for i in range(40_000)), " \x1c", "A" * 3 + "b" * 97, "A" * 3 + "b" * 96]
    return [(i, rng.choice(texts), rng.choice(["en", "de", None])) for i in ids]


def as_dict(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


def test_audit_retracts_over_micro_batches_and_calls(spark, tmp_path):
    rng = random.Random(8)
    ids = list(range(-20, 180)) + [7, 7, 8] + [None, None, None]
    rng.shuffle(ids)
    rows = audit_rows(rng, ids)
    rows += [r for r in rows if r[0] == 7]  # rows repeated whole
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 170, 2)] + [(10, 1, 1), (10, 0, 0), (None, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, t, p, "s", 0, 3, 4) for i, t, p in rows], DOCS + ", mask int, part int")
    path, folder = str(tmp_path / "documents.parquet"), str(tmp_path / "kept")
    early = docs.where("pmod(coalesce(doc_id, 1), 3) <> 0")
    early.repartition(9).write.parquet(path)
    got = filter_audit.audit(spark, path, lab, folder)
    first = [r for r in rows if (1 if r[0] is None else r[0]) % 3]
    assert as_dict(got) == slow_audit(first, labels)
    docs.where("pmod(coalesce(doc_id, 1), 3) = 0").repartition(11).write.mode("append").parquet(path)
    again = filter_audit.audit(spark, path, lab, folder)  # only the new files are read
    assert as_dict(again) == slow_audit(rows, labels)
    assert spark.read.parquet(f"{folder}/counters").select("batch").distinct().count() > 4
    assert spark.read.parquet(f"{folder}/counters").where("n < 0").count() > 0  # something was taken back


def test_audit_of_nothing(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    assert filter_audit.audit(spark, path, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# --- periodic runs


def slow_runs(w):
    """All runs by comparing the words at every lag."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            seg = w[s:i + q]
            if len(seg) >= max(24, 3 * q) and not any(seg[p:] == seg[:len(seg) - p] for p in range(1, q)):
                out.append((s, len(seg), q))
    return sorted(out)


def slow_row(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, runs and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def nested(rng, depth):
    """Words of repeated blocks within repeated blocks."""
    if depth == 0:
        return [rng.choice("ab" if rng.random() < .3 else "abcdefghij") + str(rng.randint(0, 2)) for _ in range(rng.randint(1, 14))]
    inner = nested(rng, depth - 1)
    return inner * rng.randint(1, 5) + (nested(rng, depth - 1) if rng.random() < .5 else [])


def test_runs_of_nested_repetitions():
    rng = random.Random(4)
    for _ in range(400):
        w = (nested(rng, 3) + nested(rng, 2))[:900]
        number = {x: i for i, x in enumerate(dict.fromkeys(w))}
        assert periodic_runs.runs_of(np.array([number[x] for x in w], np.int64)) == slow_runs(w)


def test_overlapping_periods_with_doubled_segments():
    a, b = [[f"{c}{i}" for i in range(20)] for c in "ab"]
    w = (a + a + a + b + b + b + a + b) * 4  # every long gram comes more than once in a period
    number = {x: i for i, x in enumerate(dict.fromkeys(w))}
    got = periodic_runs.runs_of(np.array([number[x] for x in w], np.int64))
    assert got == slow_runs(w) and (0, len(w), 160) in got


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(nested(rng, 2)[:400]) + rng.choice(["", " "])) for i in range(250)]
    rows += edge_rows()[:3] + edge_rows()[5:] + [(400, "w " * 30_000), (401, "one two three " * 8), (401, "one two three " * 8), (402, "  a"),
                                                 (-5, "a b " * 12), (None, "a " * 24), (403, "a " * 23)]
    df = spark.createDataFrame([(i, t, None, None, None, 1, 2) for i, t in rows], DOCS + ", runs int, n int")
    df.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))
                  for r in periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect())
    slow = [(i, t) for i, t in rows if i != 400]
    assert {r for r in got if r[0] == 400} == {(400, 1, 0, 30_000, 1, 30_000_000, sha("0,30000,1\n"), sha("w"))}
    assert Counter({r: n for r, n in got.items() if r[0] != 400}) == Counter(slow_row(*r) for r in slow)


def test_periodic_runs_of_nothing(spark, nothing):
    assert periodic_runs.find(nothing).count() == 0


def test_runs_do_not_cross_documents(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLICE_BYTES", 500)
    df = spark.createDataFrame([(i, "a b c d " * 4) for i in range(60)], "doc_id long, text string")
    assert {len(r.runs) for r in periodic_runs.find(df.coalesce(1)).collect()} == {0}


# --- sentence pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def random_text(rng):
    parts = [" ", "▁", "a", "e", "th", "in", "er", "\n", "\t", "日", "\U0001f600", "\x00", "é", "<s>", "<0x41>", "ﬁ",
             " ", "　", "�", "ጀ", "aaaaaaaa", "      ", "1", "2024", "."]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 150)))


def test_agendas_equal_the_library(library):
    rng = random.Random(2)
    of = [random_text(rng) for _ in range(3000)] + ["", " ", "a ", "ab" * 40_000]
    enc = sentence_pieces.Encoder(MODEL, memory=500)
    theirs = library.encode(of)
    assert [np.frombuffer(x, np.int32).tolist() for x in enc.encode(of)] == theirs
    one_by_one = [enc.model.by_agenda("▁" + t.replace(" ", "▁")) if t else [] for t in of[:500]]
    assert one_by_one == theirs[:500]


def test_decoding_equals_the_library(library):
    rng = random.Random(3)
    enc = sentence_pieces.Encoder(MODEL)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), 0, 1, 2, 28_705, 259]) for _ in range(rng.randint(0, 12))]
        assert enc.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_check_raises_on_other_ids(library):
    enc = sentence_pieces.Encoder(MODEL, checked=True)
    ids = [np.array(library.encode(x), np.int32).tobytes() for x in ("some", "words", "more")]
    enc.check(["some", "", "words", "more"], [ids[0], b"____", *ids[1:]])
    for wrong in (["some", "words", "most"], ["some", "more", "words"]):
        with pytest.raises(ValueError, match="another way"):
            enc.check(wrong, ids)
    rng = random.Random(9)
    of = [random_text(rng) for _ in range(500)]
    assert [np.frombuffer(x, np.int32).tolist() for x in enc.encode(of)] == library.encode(of)


def expected_pieces(library, rows):
    return Counter((d, len(ids := library.encode(t or "")), sha(",".join(map(str, ids))), sha(library.decode(ids))) for d, t in rows)


def got_pieces(df):
    from pyspark.sql import functions as F

    both = sentence_pieces.decode(sentence_pieces.encode(df, MODEL), MODEL)
    return Counter((r.doc_id, r.n_tokens, sha(r.s), sha(r.decoded)) for r in both.select(
        "doc_id", "n_tokens", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("s"), "decoded").collect())


def test_sentence_pieces_of_tables(spark, edges, nothing, documents, library):
    assert got_pieces(edges) == expected_pieces(library, edge_rows())
    assert got_pieces(nothing) == Counter()
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                  for r in sentence_pieces.op13_sentence_pieces(spark, "/root/testdata/sf0.001").collect())
    assert got == expected_pieces(library, rows)


def test_decode_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, [28_705, 264], "x"), (2, None, "y"), (3, [], "z")], "doc_id long, ids array<int>, decoded string")
    assert {(r.doc_id, r.decoded) for r in sentence_pieces.decode(df, MODEL).collect()} == {(1, " a"), (2, ""), (3, "")}
