"""Similarity join on word 5-grams: MinHash bands propose, full n-gram sets decide."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import lean, table, texts, written
from pathloom.llm.components import components
from pathloom.llm.pieces import slices

WORDS = 5            # of an n-gram
SIMILARITY = 0.8
TARGET_RECALL = 0.9999
ROWS = 5             # of a band; steep enough that pairs at 0.5 meet in half the cases
PAIR_BUCKET = 16     # members a bucket may have to be listed as pairs; larger ones go to tiles
BLOCK_NGRAMS = 200_000  # n-grams of one side of a tile, about
BLOCK_MEMBERS = 512  # members of one side of a tile, about
BROADCAST_KEYS = 200_000  # some 10 MB; with more keys the join shuffles

WORD = re.compile(r"\w+")


def bands_for(similarity: float, rows: int = ROWS, recall: float = TARGET_RECALL) -> int:
    """Bands so that a pair at ``similarity`` shares one with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity ** rows)))


def words_of(text: str) -> list[str]:
    """Lower-case words; of a text without any, what stands between white space."""
    text = text.lower()
    return WORD.findall(text) or text.split()


def ngram_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a shorter text is one n-gram, an
    empty one has none."""
    import xxhash

    w = words_of(text)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    span = min(words, len(w))
    if not span:
        return h
    at = np.zeros(len(w) - span + 1, np.uint64)
    for k in range(span):
        at = at * np.uint64(0x9E3779B97F4A7C15) + h[k:len(w) - span + 1 + k]
        at ^= at >> np.uint64(31)
    return np.unique(at)


def band_hashes(ngrams: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash of each band of the signature."""
    rng = np.random.default_rng(20)
    factor = rng.integers(0, 2 ** 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for at in range(0, len(ngrams), 2048):
        least = np.minimum(least, (ngrams[at:at + 2048, None] * factor).min(axis=0))
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for column in least.reshape(bands, rows).T:
        out = (out ^ (column >> np.uint64(29)) ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def set_key(ngrams: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(ngrams.tobytes())


def signatures(docs: DataFrame, bands: int) -> DataFrame:
    """doc_id, key of its n-gram set, size of the set, band hashes (none of an empty set)."""
    def run(batches):
        for pdf in batches:
            at = 0
            for part in slices(pdf["text"].tolist()):
                rows = []
                for t in part:
                    s = ngram_hashes(t)
                    rows.append((set_key(s), len(s), band_hashes(s, bands) if len(s) else []))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at:at + len(part)].array, "key": [r[0] for r in rows],
                                    "n": [r[1] for r in rows], "bands": [r[2] for r in rows]})
                at += len(part)
    return texts(docs).mapInPandas(lean(run), "doc_id long, key binary, n long, bands array<long>")


def ngram_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, ngrams) of the ``wanted`` (doc_id, key), one row a key."""
    def run(batches):
        for pdf in batches:
            keys = iter(pdf["key"].tolist())
            for part in slices(pdf["text"].tolist()):  # n-grams take more room than their text
                sets = [(k, s) for s, k in zip(map(ngram_hashes, part), keys) if set_key(s) == k]
                yield pd.DataFrame({"key": [k for k, _ in sets], "ngrams": [s.view(np.int64) for _, s in sets]})
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    found = texts(docs).withColumnRenamed("doc_id", "i").join(wanted, F.col("i").eqNullSafe(F.col("doc_id")))
    return found.select("key", "text").mapInPandas(lean(run), "key binary, ngrams array<long>").dropDuplicates(["key"])


def overlap(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of ``left`` with ``right``."""
    values, inverse = np.unique(np.concatenate(left + right), return_inverse=True)
    shared = np.bincount(inverse, minlength=len(values)) > 1  # the others meet nothing
    column = np.cumsum(shared) - 1
    width = int(shared.sum())
    ends = np.cumsum([len(s) for s in left + right])
    rows = np.repeat(np.arange(len(ends)), [len(s) for s in left + right])
    rows, cols = rows[shared[inverse]], column[inverse][shared[inverse]]
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, width, 4096):
        here = (cols >= at) & (cols < at + 4096)
        grid = np.zeros((len(ends), min(4096, width - at)), np.float32)
        grid[rows[here], cols[here] - at] = 1
        total += grid[: len(left)] @ grid[len(left):].T
    return total


def forest(linked: np.ndarray) -> np.ndarray:
    """Parent of each node in a spanning forest of a symmetric boolean matrix (roots: -1)."""
    parent = np.full(len(linked), -2)
    for root in range(len(linked)):
        if parent[root] != -2:
            continue
        parent[root], front = -1, np.array([root])
        while len(front):
            reach = linked[front]
            new = np.flatnonzero(reach.any(axis=0) & (parent == -2))
            parent[new] = front[reach[:, new].argmax(axis=0)]
            front = new
    return parent


def link_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the two sides of one tile of a crowded bucket: of each member the documents
    linked to it and the neighbour that ties it into the tile's forest.

    A pair that meets in several crowded buckets counts in the first of them only."""
    pdf = pdf.sort_values("key", kind="stable").reset_index(drop=True)
    i, j, bucket = (int(pdf[c].iloc[0]) for c in ("i", "j", "bucket"))
    left = np.flatnonzero(pdf["block"] == i)
    right = left if i == j else np.flatnonzero(pdf["block"] == j)
    empty = pd.DataFrame({"a": [], "b": [], "links": []}).astype({"a": object, "b": object, "links": "int64"})
    if not len(left) or not len(right):
        return empty
    sets, crowded = pdf["ngrams"].tolist(), pdf["crowded"].tolist()
    size = np.array([len(s) for s in sets])
    common = overlap([sets[x] for x in left], [sets[x] for x in right])
    linked = common >= SIMILARITY * (size[left][:, None] + size[right][None, :] - common) - 1e-6
    places = {}
    for x, own in enumerate(crowded):  # own: crowded buckets by band
        for b in own:
            if b == bucket:
                break
            places.setdefault(b, []).append(x)
    for members in places.values():
        inside = np.zeros(len(pdf), bool)
        inside[members] = True
        linked &= ~(inside[left][:, None] & inside[right][None, :])
    copies = pdf["copies"].to_numpy()
    if i == j:
        np.fill_diagonal(linked, False)
        links, whole = linked @ copies[left], linked
        order = left
    else:
        links = np.r_[linked @ copies[right], copies[left] @ linked]
        whole = np.zeros((len(left) + len(right),) * 2, bool)
        whole[: len(left), len(left):] = linked
        whole |= whole.T
        order = np.r_[left, right]
    parent, keys = forest(whole), pdf["key"].to_numpy()
    some = links > 0
    return pd.DataFrame({
        "a": keys[order[some]],
        "b": [keys[order[p]] if p >= 0 else None for p in parent[some]],
        "links": links[some].astype(np.int64)}) if some.any() else empty


def similarity_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every row of ``docs`` (doc_id, text).

    Documents are linked when the Jaccard similarity of their sets of word 5-grams is at least
    0.8.  n_links counts the other documents linked to one, n_copies those with its very set
    (itself included, all of them linked too), class_id is the least doc_id of all that links
    join, directly or over others.

    Documents with one set are one class from the start.  Band hashes of the sets are
    shuffled; a bucket of up to ``PAIR_BUCKET`` sets gives pairs, each verified once.  A larger
    one is cut into blocks; every tile of two blocks verifies its pairs inside a task and
    gives counts and a forest instead of pairs.  No bucket is capped or sampled.  Bands reach
    ``TARGET_RECALL`` at 0.8.

    Words are lower-case runs of letters and digits (without any: what white space parts).  A
    text with fewer than five is one n-gram; a missing or empty one has none and is a copy
    of the other empty ones alone.  Repeated rows are copies.  Rows without doc_id take part;
    a class of such rows alone has a null class_id.  An empty table gives no rows; other
    columns go.
    """
    sig = written(signatures(docs, bands_for(SIMILARITY)), "signatures")
    sets = written(sig.groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
        F.first("bands").alias("bands")), "sets")
    member = sets.select("key", "n", "copies", F.posexplode("bands").alias("band", "bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size")).where("m > 1")
    member = written(member.join(shared, "bucket"), "buckets")

    crowd = member.where(F.col("m") > PAIR_BUCKET)
    crowded = crowd.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "bucket"))),
                                                   lambda s: s["bucket"]).alias("crowded"))
    wanted = sets.join(member.select("key").distinct(), "key").select(F.col("rep").alias("doc_id"), "key")
    ngrams = written(ngram_sets(docs, written(wanted, "wanted")), "ngrams")

    # pairs of the small buckets
    lists = member.where(F.col("m") <= PAIR_BUCKET).groupBy("bucket").agg(
        F.array_sort(F.collect_list(F.struct("key", "n"))).alias("x"))
    pairs = lists.select(F.explode(F.flatten(F.transform("x", lambda p, i: F.transform(
        F.slice("x", i + 2, F.size("x")), lambda q: F.struct(p.alias("p"), q.alias("q")))))).alias("s")).select(
        F.col("s.p.key").alias("a"), F.col("s.q.key").alias("b"), F.col("s.p.n").alias("na"), F.col("s.q.n").alias("nb"))
    pairs = pairs.where(F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb") - 1e-6).distinct()
    side = lambda c: ngrams.join(crowded, "key", "left").join(sets.select("key", "copies"), "key").select(
        F.col("key").alias(c), F.col("ngrams").alias(f"g{c}"), F.col("crowded").alias(f"crowded_{c}"),
        F.col("copies").alias(f"copies_{c}"))
    common = F.size(F.array_intersect("ga", "gb"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(
        ~F.coalesce(F.arrays_overlap("crowded_a", "crowded_b"), F.lit(False))
        & (common >= SIMILARITY * (F.col("na") + F.col("nb") - common) - 1e-6))
    pairs = written(pairs.select("a", "b", "copies_a", "copies_b"), "pairs")

    # tiles of the crowded ones
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_NGRAMS), F.ceil(F.col("m") / BLOCK_MEMBERS)).cast("int")
    tiles = crowd.withColumn("k", blocks).withColumn("block", F.expr("pmod(xxhash64(key), k)").cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "copies")
    tiles = tiles.join(ngrams.join(crowded, "key"), "key")
    tiles = written(tiles.groupBy("bucket", "i", "j").applyInPandas(link_tile, "a binary, b binary, links long"), "tiles")

    links = pairs.select(F.col("a").alias("key"), F.col("copies_b").alias("links")).unionByName(
        pairs.select(F.col("b").alias("key"), F.col("copies_a").alias("links"))).unionByName(
        tiles.select(F.col("a").alias("key"), "links")).groupBy("key").agg(F.sum("links").alias("links"))
    root = components(pairs.select("a", "b").unionByName(tiles.where("b is not null").select("a", "b")))
    named = sets.select("key", "rep", "copies").join(root.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "root", F.coalesce("root", "key"))
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("class_id")), "root").join(links, "key", "left")
    named = written(named, "classes")  # so that a set with very many copies is split in the last join
    return sig.select("doc_id", "key").join(named, "key").select(
        "doc_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("copies").alias("n_copies"))


def op1_ngram_join(spark, sf_dir):
    return similarity_join(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_join": op1_ngram_join}
