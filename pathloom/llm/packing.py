"""Packing of tokenized documents into windows by multiway differencing."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import lean, table, texts
from pathloom.llm.pieces import encoder, forget, slices, tokenizer_path

CAPACITY = 2048   # tokens a window holds
CUT = 512         # longest piece of what is left of a document behind its full windows
BIN_DOCS = 2048   # documents packed together, on average
END_ID = 1        # closes a document
SLICE_CHARS = 2_000_000  # characters encoded together, one text at least
VOCABULARY = "byte_bpe_50k.json"

DOC_SCHEMA = "doc_id long, doc_tokens long, crcs array<long>, ids binary"
PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                "sequence_id long, offset long, ids binary")


def cut_lengths(n: int, capacity: int = CAPACITY, cut: int = CUT) -> list[int]:
    """Piece lengths of a document of ``n`` tokens: full windows, then pieces up to ``cut``."""
    full, rest = divmod(n, capacity)
    more, last = divmod(rest, cut)
    return [capacity] * full + [cut] * more + [last] * (last > 0)


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp differencing of ``sizes`` over ``k`` windows: (window of each, loads).

    The sizes in falling order, k at a time, make the first partial partitions.  The two with
    the largest imbalance merge, the heaviest window of one with the lightest of the other,
    until one partition is left.
    """
    order = np.argsort(-sizes, kind="stable")
    rows = -(-len(sizes) // k)
    grid = np.full(rows * k, -1, np.int64)
    grid[: len(sizes)] = order
    heap = []
    for r, members in enumerate(grid.reshape(rows, k)):
        load = np.where(members >= 0, sizes[members], 0)
        heap.append((-int(load.max() - load.min()), r, load, [members]))
    heapq.heapify(heap)
    label = rows
    while len(heap) > 1:
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        down, up = np.argsort(-a, kind="stable"), np.argsort(b, kind="stable")
        load = a[down] + b[up]
        heapq.heappush(heap, (-int(load.max() - load.min()), label, load,
                              [m[down] for m in of_a] + [m[up] for m in of_b]))
        label += 1
    _, _, load, members = heap[0]
    window = np.empty(len(sizes), np.int64)
    for m in members:
        used = m >= 0
        window[m[used]] = np.flatnonzero(used)
    return window, load


def balance(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window of each size; one more half percent of windows as long as one overflows.  With
    as many windows as sizes each has its own, so this ends."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, load = difference(sizes, k)
        if load.max() <= capacity:
            return window
        k += max(1, k // 200)


def tokenized(docs: DataFrame, vocabulary: str, carry_ids: bool = False) -> DataFrame:
    """A row per document: number of ids with the closing one, CRC-32 of each piece, and the
    ids themselves (unsigned 32-bit, little-endian) if asked for."""
    def run(batches):
        end = np.uint32(END_ID).tobytes()
        for pdf in batches:
            at = 0
            for part in slices(pdf["text"].tolist(), SLICE_CHARS):
                rows = []
                for doc, raw in zip(pdf["doc_id"].iloc[at:at + len(part)], encoder(vocabulary).encode(part)):
                    raw, crcs, p = raw + end, [], 0
                    for n in cut_lengths(len(raw) // 4):
                        crcs.append(zlib.crc32(raw[4 * p:4 * (p + n)]))
                        p += n
                    rows.append((doc, len(raw) // 4, crcs, raw if carry_ids else None))
                at += len(part)
                yield pd.DataFrame(rows, columns=["doc_id", "doc_tokens", "crcs", "ids"]).astype(
                    {"doc_id": "Int64"})
        forget()
    return texts(docs).mapInPandas(lean(run), DOC_SCHEMA)


def pack_bin(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pieces of one bin of documents with their windows; the order of rows has no effect."""
    bin_id = int(pdf["bin"].iloc[0])
    pdf = pdf.assign(first=[c[0] for c in pdf["crcs"]]).sort_values(
        ["doc_id", "doc_tokens", "first"], kind="stable", na_position="first")
    docs, tokens = pdf["doc_id"].to_numpy(), pdf["doc_tokens"].to_numpy()
    lengths = [cut_lengths(int(n)) for n in tokens]
    each = np.array([len(x) for x in lengths])
    row = np.repeat(np.arange(len(pdf)), each)
    length = np.concatenate(lengths).astype(np.int64)
    before = np.cumsum(length) - length
    start = before - np.repeat(before[np.cumsum(each) - each], each)
    window = np.empty(len(length), np.int64)
    full = length == CAPACITY
    window[full] = np.arange(full.sum())
    if (~full).any():
        window[~full] = full.sum() + balance(length[~full])
    by = np.lexsort((start, row, window))
    load_before = np.cumsum(length[by]) - length[by]
    opens = np.r_[True, np.diff(window[by]) > 0]
    offset = np.empty(len(length), np.int64)
    offset[by] = load_before - np.maximum.accumulate(np.where(opens, load_before, 0))
    ids = pdf["ids"].tolist()
    return pd.DataFrame({
        "doc_id": pd.array(docs, "Int64")[row], "start": start, "length": length,
        "ids_crc32": np.concatenate(pdf["crcs"].to_numpy()).astype(np.int64),
        "doc_tokens": tokens[row].astype(np.int64),
        "sequence_id": (bin_id << 32) + window, "offset": offset,
        "ids": [None if ids[r] is None else ids[r][4 * s:4 * (s + n)]
                for r, s, n in zip(row, start, length)],
    })


def pack(docs: DataFrame, vocabulary: str, carry_ids: bool = False, bin_docs: int = BIN_DOCS) -> DataFrame:
    """Pieces of all documents in windows of at most ``CAPACITY`` ids.

    A document is cut into full windows and pieces of at most ``CUT`` ids.  Documents are dealt
    by a hash of their row into bins of about ``bin_docs``; each bin is balanced by itself, so
    no bin grows with the corpus and copies of one text spread.  Two bins never share a window.
    A missing or empty text is the closing id alone.  Repeated rows are packed each.  A row
    without doc_id keeps a null one.  An empty table gives no piece.  Other columns go.
    """
    bins = max(1, -(-docs.count() // bin_docs))
    rows = tokenized(docs, vocabulary, carry_ids)
    dealt = rows.withColumn("bin", F.expr(f"pmod(xxhash64(doc_id, doc_tokens, crcs), {bins})"))
    return dealt.groupBy("bin").applyInPandas(pack_bin, PIECE_SCHEMA)


def op10_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY)).drop("ids")


QUERIES = {"op10_packing": op10_packing}
