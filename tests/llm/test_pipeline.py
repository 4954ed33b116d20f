import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pathloom.llm import packing
from pathloom.llm.pieces import PieceEncoder, tokenizer_path

from .conftest import edge_rows
from .test_pairs_and_copies import brute_copies, brute_links

SF = "/root/testdata/sf0.001"
JSON = tokenizer_path(packing.VOCABULARY)


def check_pieces(rows, docs):
    """All ids of all documents once, in gapless sequences of at most 2048."""
    enc = PieceEncoder(JSON)
    want = Counter()
    for d, t in docs:
        ids = np.r_[np.frombuffer(enc.encode([t or ""])[0], np.uint32), np.uint32(1)].astype(np.uint32)
        at = 0
        for n in packing.cut_lengths(len(ids)):
            want[d, at, n, zlib.crc32(ids[at:at + n].tobytes()), len(ids)] += 1
            at += n
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    windows = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert windows.get(r["sequence_id"], 0) == r["offset"]
        windows[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(windows.values(), default=0) <= packing.CAPACITY
    return windows


def test_packing(edges, nothing, documents):
    check_pieces(packing.pack(edges, JSON).collect(), edge_rows())
    assert packing.pack(nothing, JSON).count() == 0
    own = [(r["doc_id"], r["text"]) for r in documents.collect()]
    windows = check_pieces(packing.pack(documents, JSON, bin_docs=64).collect(), own)
    full = packing.pack(documents, JSON, carry_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in full)
    whole = check_pieces(full, own)
    for w in (windows, whole):
        assert sum(w.values()) / (packing.CAPACITY * len(w)) > 0.94


@pytest.mark.parametrize("sizes", [[5], [2048] * 3, [512] * 9, list(range(1, 513)), [1]])
def test_windows_hold_at_most_their_capacity(sizes):
    sizes = np.array(sizes)
    window = packing.balance(sizes)
    load = np.bincount(window, sizes)
    assert load.max() <= packing.CAPACITY and load.sum() == sizes.sum()
    if len(sizes) > 100:
        assert load.max() - load[load > 0].min() <= 64


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    cols, seen = docs.columns, set(text)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert out.columns == cols and out.dtypes == docs.dtypes
        ids = [r["doc_id"] for r in out.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen
        rows = [(d, text[d]) for d in sorted(seen)]
        if name == "exact_dedup":
            assert set(ids) == {k[0] for k in brute_copies(rows) if k[3]}
        if name == "near_dedup":
            assert set(ids) == {k[0] for k in brute_links(rows) if k[0] == k[1]}
        docs, seen = out, set(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_pieces(last, [(d, text[d]) for d in seen])
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, last))


def test_pipeline_stages_on_edge_cases(spark, edges, nothing):
    docs = edges.select(*corpus_pipeline.COLUMNS, "score", "lang_pred", "kept")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, SF), name)
        none = stage(spark, nothing, SF)
        assert none.count() == 0 and none.columns == out.columns
        if name == "exact_dedup":
            assert Counter((r["doc_id"], r["text"]) for r in out.collect())[6, "repeated whole row here\nwith two lines"] == 1
