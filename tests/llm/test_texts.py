import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pathloom.llm import bpe, fingerprint, html_text, language_id, pieces, quality, token_counts, url_filter
from pathloom.llm.common import held_out

from .conftest import edge_rows

SF = "/root/testdata/sf0.01"
JSON, MULTI = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", bpe.VOCABULARY))


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})


def merged(token, ranks):
    """Byte pairs of a pre-token merged one by one, the least rank first."""
    parts = [bytes([b]) for b in token]
    while True:
        best = min(((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
        if best[0] == 1 << 30:
            return [ranks[p] for p in parts]
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_word_encoder_merges_by_rank():
    ranks, encode = bpe.read_ranks(MULTI), bpe.word_encoder(MULTI)
    for w in [" Größe", "abcabcabc", "!!!???", " 2024", "ñandú", "\n\n", "\u4e2d\u6587"]:
        assert encode(w) == merged(w.encode(), ranks)


def expected_ids(rows):
    enc, out = tiktoken_encoding(), Counter()
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        out[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((t or "").encode()).hexdigest()] += 1
    return out


def test_bpe_equals_tiktoken(edges, nothing, documents, monkeypatch):
    got = lambda df: Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
                             for r in bpe.encode(df, MULTI, digests=True).collect())
    assert got(edges) == expected_ids(edge_rows())
    assert got(nothing) == Counter()
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 20_000)  # many blocks
    monkeypatch.setattr(bpe, "CHUNK", 700)
    assert got(documents) == expected_ids([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_ids_and_decoding(spark, documents):
    rows = bpe.encode(documents, MULTI)
    enc = tiktoken_encoding()
    want = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert {r["doc_id"]: r["ids"] for r in rows.collect()} == {d: enc.encode_ordinary(t) for d, t in want.items()}
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(rows, MULTI).collect()} == want
    few = spark.createDataFrame([(1, []), (2, None), (3, [5, 5])], "doc_id long, ids array<int>")
    table = {v: k for k, v in bpe.read_ranks(MULTI).items()}
    assert {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(few, MULTI).collect()} == {1: b"", 2: b"", 3: table[5] * 2}


def test_another_order_is_noticed():
    import pandas as pd

    docs = pd.DataFrame({"block": [1], "words": [1], "check": [5], "doc_id": [1], "codes": [bpe._packed(bpe.array("I", [0]))]})
    with pytest.raises(ValueError):
        bpe._reassembled(MULTI, True)(docs, pd.DataFrame({"block": [], "entries": []}))


def test_ranks_merge_as_the_rules_do():
    enc = pieces.PieceEncoder(JSON)
    assert enc.ranks is not None
    words = [w for w in (enc.tokenizer.decode([i]) for i in range(0, 50256, 3)) if "\ufffd" not in w]
    rng = random.Random(11)
    rows = ["".join(rng.choices(words, k=20)) for _ in range(2000)]
    rows += ["".join(rng.choices(" aetn'sr,.\n\u00e9\u00df\u03c9\u0436\u054a\u4e2d\u0301\u00a012", k=60)) for _ in range(2000)]
    assert [np.frombuffer(x, np.uint32).tolist() for x in enc.encode(rows)] == [
        e.ids for e in enc.tokenizer.encode_batch(rows, add_special_tokens=False)]


def test_rules_out_of_the_order_of_ids_keep_the_library():
    from tokenizers import Tokenizer

    rules = json.loads(Tokenizer.from_file(JSON).to_str())
    rules["model"]["merges"][:2] = rules["model"]["merges"][1::-1]
    assert pieces.rank_encoder(Tokenizer.from_str(json.dumps(rules))) is None


def test_pieces_encode_as_whole_texts():
    enc = pieces.PieceEncoder(JSON, memory=50)
    texts = [t or "" for _, t in edge_rows()] + ["  ", " a", "a  b", " \n x", "x\x00 y z", "a \x1c b", "\n\n a\n\n", " 's a 's b"]
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(raw, np.uint32).tolist() for raw in enc.encode(texts)] == want
    assert all("".join(pieces.split_pieces(t)) == t for t in texts)


def test_length_histogram(spark, edges, nothing):
    enc = pieces.PieceEncoder(JSON)
    n = [len(raw) // 4 for raw in enc.encode([t or "" for _, t in edge_rows()])]
    sums = token_counts.token_counts(edges, JSON).cache()
    assert {r["n"]: r["docs"] for r in sums.collect()} == Counter(n)
    for r in sums.collect():
        c = r["n"]
        assert (r["all_docs"], r["all_tokens"]) == (len(n), sum(n))
        assert (r["docs_from"], r["tokens_from"]) == (sum(x >= c for x in n), sum(x for x in n if x >= c))
        assert r["truncated_tokens"] == sum(min(x, c) for x in n)
        assert abs(r["share_up_to"] - sum(x <= c for x in n) / len(n)) < 1e-12
    limits = [0, 1, 5, 100, 10 ** 6]
    assert {r["context"]: r["tokens"] for r in token_counts.truncated_totals(sums, limits).collect()} == {
        c: sum(min(x, c) for x in n) for c in limits}
    assert token_counts.quantile(sums, 0.5) == sorted(n)[(len(n) + 1) // 2 - 1]
    none = token_counts.token_counts(nothing, JSON)
    assert none.count() == 0 and token_counts.quantile(none, 0.5) is None


def plain_marks(hashes, units):
    """Counters of a text added up in Python: ``hashes`` are the unit hashes of each kind, with their counts."""
    out = []
    for kind in hashes:
        for j in range(fingerprint.LANES):
            lanes = [sum(n for h, n in kind if (h & (1 << 64) - 1) >> (j + 21 * k) & 1) % (1 << 21) for k in range(3)]
            out.append(sum(c << 21 * k for k, c in enumerate(lanes)))
    return out


def test_fingerprint_counters_at_any_length(spark):
    many = 2_100_000  # more units than a counter holds
    rows = [(1, "b\n" + "a." * many, {"a": many, "b": 1}), (2, "a." * many + "\nb", {"a": many, "b": 1}),
            (3, "one, two; two", {"one": 1, " two": 2}), (4, "", {}),
            (5, "b", {"b": 1}), (6, "a." * many, {"a": many})]
    df = spark.createDataFrame([r[:2] for r in rows], "i int, text string")
    fps = df.repartition(6, "i").select("i", fingerprint.fingerprint(F.col("text")).alias("fp"))
    got = {r["i"]: r for r in fps.collect()}
    both = spark.createDataFrame([(got[5]["fp"], got[6]["fp"])], fps.select(
        F.col("fp").alias("a"), F.col("fp").alias("b")).schema)
    both = both.select(fingerprint.joined(F.col("a"), F.col("b")).alias("fp")).first()
    for i, _, units in rows:
        names = spark.createDataFrame([(u, n) for u, n in units.items()] or [("", 0)], "u string, n long").select(
            "n", *[F.xxhash64("u", F.lit(k)).alias(f"h{k}") for k in range(fingerprint.HASHES)]).collect()
        want = plain_marks([[(r[f"h{k}"], r["n"]) for r in names] for k in range(fingerprint.HASHES)], units)
        assert got[i]["fp"]["marks"] == want and got[i]["fp"]["units"] == sum(units.values())
    assert got[1]["fp"] == got[2]["fp"] == both["fp"]
    assert len(set(got[3]["fp"]["marks"])) > 21 and got[3]["fp"]["marks"][:21] != got[3]["fp"]["marks"][21:]


def test_fingerprints_are_sums(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice("abc .,") for _ in range(rng.randint(1, 90))) for _ in range(12)]
    a, b = lines[:7], lines[7:] + lines[:2]
    df = spark.createDataFrame([("\n".join(a), "\n".join(b), "\n".join(a + b), "\n".join(reversed(a)))], "a string, b string, ab string, r string")
    fp = {c: fingerprint.fingerprint(F.col(c)) for c in df.columns}
    row = df.select((fingerprint.joined(fp["a"], fp["b"]) == fp["ab"]).alias("sum"), (fp["r"] == fp["a"]).alias("order"),
                    (fingerprint.without(fp["ab"], fp["b"]) == fp["a"]).alias("less"), (fp["a"] == fp["b"]).alias("same"),
                    fingerprint.likeness(fp["a"], fp["r"]).alias("one")).first()
    assert row["sum"] and row["order"] and row["less"] and not row["same"] and row["one"] == 1.0


def brute_edits(rows):
    rows = [(d, t or "") for d, t in rows]
    out = {}
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        out[d] = (len(t), hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest())
    return out


def test_edited_texts_and_likeness(spark, documents):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    rows = fingerprint.op3_fingerprints(spark, "/root/testdata/sf0.001").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    own = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in rows} == brute_edits(own)
    assert np.mean([r["near_edited"] for r in rows]) > np.mean([r["near_next"] for r in rows]) + 0.3
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    text = dict(own)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert len(set(by_text.values())) == len(by_text)


def test_edits_of_edge_cases(edges, nothing, spark):
    assert fingerprint.edited(edges).count() == len(edge_rows())
    assert fingerprint.edited(nothing).count() == 0
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert fingerprint.edited(one).first()["edited"] == "abab"


def test_main_text():
    page = ("<body><header id=top><h1>Site</h1></header><div class='cookieNotice'>We use cookies</div><main>"
            "<article class='post with-sidebar'><header><h1>Title</h1></header><section><p>One <a href=x>link</a> "
            "two.</p></section><section><p>Three &amp; four</p><aside>no</aside></section><section id='comments'>"
            "<article class='comment'>bad bad bad bad bad bad bad bad</article></section></article>"
            "<div class='related-posts'>r</div></main><footer>&copy;</footer></body>")
    assert html_text.main_text(page) == "Title One link two. Three & four"
    bare = ("<div id=nav><a>x</a></div><div><div><p>Hello world this is a long text about things.</p><p>More text "
            "here<br>new  line</p></div><div class=sidebar>side</div></div><div class=footer>&copy; footer</div>")
    assert html_text.main_text(bare) == "Hello world this is a long text about things. More text here new line"
    for source, want in ((None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b<ul><li>c<li>d</ul>", "a b c d"),
                         ("<!-- open", ""), ("<script>x", ""), ("<a href='>'>q</a> t", "q t"), ("<b>a</b>b", "ab"),
                         ("<p>" * 30_000 + "deep", "deep")):
        assert html_text.main_text(source) == want


def test_extraction_of_tables(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "clash"), (1, "u", "<p>x</p>", "clash"), (None, None, None, "y")],
                                  "page_id long, url string, html string, text string")
    rows = sorted(map(tuple, html_text.extract(pages).collect()), key=str)
    assert rows == [(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_quality_is_learned(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert np.mean(good) >= 0.92 and np.mean(bad) <= 0.2  # some 40 bad texts to learn from


def test_kinds_told_apart_completely_keep_finite_weights():
    rng = random.Random(8)
    good = [" ".join("".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(120)) for _ in range(60)]
    bad = [" ".join("".join(rng.choice("XQZ!#%") for _ in range(5)) for _ in range(120)) for _ in range(60)]
    model = quality.SizeModel(quality._dictionary(good[::2]), quality._dictionary(bad[::2]), 0.8)
    model.fit(bad[1::2] + good[1::2], np.repeat([0, 1], 30))
    assert np.abs(model.weights).max() < 50
    assert model.score(good).min() > 0.7 > 0.5 > model.score(bad).max()


def test_quality_on_edge_cases(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    got = quality.classify(edges, labels).collect()
    assert len(got) == len(edge_rows()) and {r["score"] for r in got if r["doc_id"] in (2, 3)} == {0.0}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.classify(edges, labels.limit(0)).collect()} == {0.0, 0.5}
    assert quality.classify(nothing, labels).count() == 0


def test_language_is_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.97


def test_joined_tables_score_like_the_network():
    net = language_id.ByteNetwork.fresh(["a", "b", "c"])
    x = np.random.default_rng(1).integers(0, 256, (5, language_id.WINDOW), np.uint8)
    h = np.concatenate([net.responses(x, w).max(axis=1) for w in language_id.WIDTHS] + [np.ones((5, 1))], axis=1)
    assert np.allclose(net.scorer()(x), language_id.softmax(np.maximum(h, 0) @ net.out), atol=1e-5)
    assert [w.tobytes().rstrip(b"\0") for w in [language_id.windows(b"x" * 1300)]] == [b"x" * 1300]


def test_language_on_edge_cases(edges, nothing):
    rows = language_id.identify(edges).collect()
    assert len(rows) == len(edge_rows())
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 9, 10)} == {"und"}
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 4)} == {"en"}
    assert language_id.identify(nothing).count() == 0


def test_held_out_rows(spark):
    import zlib

    rows = held_out(spark.range(200).withColumnRenamed("id", "doc_id")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de", "block"), ("org", "", "block"),
             ("b.org", "/x", "allow"), ("b.org", "/x", "block")]
    urls = [None, "", "no scheme", "http://", "http://NET", "http://a.net/", "https://A.Example.NET/en/x?q#f", "x://example.net/en",
            "http://xexample.com/de", "http://example.com/deep", "http://www.example.com/de/", "http://b.org/x", "http://b.org?x/y",
            "http://a.b.org/xyz", "http://net:80/", "http://..net/", "http://a://b.net/", "http://É.net/É", "http://a.net#/x"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(3, urls[3], "again")],
                                  "page_id long, url string, rule string")
    frame = spark.createDataFrame(rules, "rule_host string, rule_path string, action string")
    got = Counter(map(tuple, url_filter.judge(pages, frame).collect()))
    want = Counter((i, *brute_verdict(urls[i], rules)) for i in [*range(len(urls)), 3])
    assert got == want
    assert url_filter.judge(pages.limit(0), frame).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, frame.limit(0)).collect()} == {"allow"}
