"""Duplicate removal, path similarity and diverse selection within cells."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from pathloom.operators.graph import edge_set

CELL_LIMIT = 2048  # largest candidate set a cell may bring to the selection step


def dedup(paths: DataFrame, cell: list[str], rank: str = "rank") -> DataFrame:
    """Keep the first occurrence (smallest rank) of every node sequence.

    A hash aggregation: repeats collapse before the shuffle, however many.
    """
    other = [c for c in paths.columns if c not in (*cell, "nodes")]
    best = paths.groupBy(*cell, "nodes").agg(
        F.min(F.struct(rank, *[c for c in other if c != rank])).alias("b"))
    return best.select(*cell, "nodes", *[F.col(f"b.{c}").alias(c) for c in other])


def similar_pairs(paths: DataFrame, cell: list[str], key: str, threshold: float) -> DataFrame:
    """Pairs of paths of one cell with edge Jaccard >= threshold, exact.

    Prefix filter: with edges ordered from rare to common, two paths that reach
    the threshold share an edge among their first n - ceil(t n) + 1.  Only those
    edges are joined, so common edges do not pair up everything; every candidate
    is then verified on its full edge set.
    """
    p = paths.select(*cell, key, F.transform(
        edge_set(), lambda e: F.concat_ws("-", e["u"], e["v"])).alias("es"))
    flat = p.select(*cell, key, F.explode("es").alias("e"))
    freq = flat.groupBy(*cell, "e").agg(F.count(F.lit(1)).alias("f"))
    ordered = flat.join(freq, [*cell, "e"]).groupBy(*cell, key).agg(
        F.array_sort(F.collect_list(F.struct("f", "e")))["e"].alias("es"))
    n = F.size("es")
    pre = ordered.select(*cell, key, "es", F.explode(
        F.slice("es", 1, (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int"))).alias("e"))
    a = pre.select(*cell, "e", F.col(key).alias("a"), F.col("es").alias("ea"))
    b = pre.select(*cell, "e", F.col(key).alias("b"), F.col("es").alias("eb"))
    cand = a.join(b, [*cell, "e"]).where("a < b").dropDuplicates([*cell, "a", "b"])
    inter = F.size(F.array_intersect("ea", "eb"))
    j = inter / (F.size("ea") + F.size("eb") - inter)
    return cand.select(*cell, "a", "b", j.alias("jaccard")).where(
        F.col("jaccard") >= threshold - 1e-12)


def set_overlap(a: DataFrame, b: DataFrame, cell: list[str], key: str) -> DataFrame:
    """Jaccard of two path sets per cell; cells of either side appear."""
    both = a.select(*cell, key, F.lit(1).alias("ia"), F.lit(0).alias("ib")).unionByName(
        b.select(*cell, key, F.lit(0).alias("ia"), F.lit(1).alias("ib")))
    per_path = both.groupBy(*cell, key).agg(F.max("ia").alias("ia"), F.max("ib").alias("ib"))
    return per_path.groupBy(*cell).agg(
        F.sum("ia").alias("n_a"), F.sum("ib").alias("n_b"),
        F.sum(F.col("ia") * F.col("ib")).alias("n_both"),
        F.count(F.lit(1)).alias("n_union")).withColumn(
        "jaccard", F.col("n_both") / F.col("n_union"))


# ---- diverse selection: one task per cell over its sampled candidates ------------


def _jaccard(nodes: list[tuple]) -> np.ndarray:
    sets = [set(zip(p[:-1], p[1:])) for p in nodes]
    index = {e: i for i, e in enumerate(sorted(set().union(*sets)))}
    inc = np.zeros((len(nodes), max(len(index), 1)))
    for i, s in enumerate(sets):
        inc[i, [index[e] for e in s]] = 1.0
    inter = inc @ inc.T
    size = inc.sum(axis=1)
    union = size[:, None] + size[None, :] - inter
    sim = np.where(union > 0, inter / np.where(union > 0, union, 1.0), 1.0)
    np.fill_diagonal(sim, 1.0)
    return sim


def _complete_link(dist: np.ndarray, cut: float) -> list[list[int]]:
    """Merge the closest clusters while their farthest members stay within ``cut``.

    Ties go to the pair with the smallest (first, second) cluster index.
    """
    d = dist.copy()
    np.fill_diagonal(d, np.inf)
    members = {i: [i] for i in range(len(d))}
    while len(members) > 1:
        flat = int(np.argmin(d))
        i, j = sorted(divmod(flat, len(d)))
        if d[i, j] > cut + 1e-12:
            break
        members[i] += members.pop(j)
        d[i] = np.maximum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j] = np.inf
        d[:, j] = np.inf
    return list(members.values())


def _spread(sim: np.ndarray, bonus: np.ndarray, k: int) -> list[int]:
    """Farthest-first over rows in lexicographic order; ties by bonus, then order."""
    far = 1.0 - sim[0]
    chosen = [0]
    free = np.ones(len(sim), dtype=bool)
    free[0] = False
    while len(chosen) < k:
        best = far[free].max()
        tied = np.flatnonzero(free & (far >= best - 1e-12))
        pick = int(tied[np.argmax(bonus[tied])])
        chosen.append(pick)
        free[pick] = False
        far = np.minimum(far, 1.0 - sim[pick])
    return chosen


def diverse_paths(paths: DataFrame, cell: list[str], keep: int = 128, jaccard: float = 0.80,
                  bonus: str | None = None) -> DataFrame:
    """Near-duplicate clusters, one medoid each, then farthest-first to ``keep``.

    Input are sampled candidates: a cell larger than ``CELL_LIMIT`` is an error,
    not a silent cut.  Cells are spread over the cluster.
    """
    src = paths.select(*cell, "nodes", (F.col(bonus) if bonus else F.lit(0)).alias("bonus"))
    schema = src.select(*cell, "nodes").schema.add("pick", IntegerType())

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > CELL_LIMIT:
            raise ValueError(f"{len(pdf)} candidates in one cell; sample ranks first")
        best: dict[tuple, int] = {}
        for nodes, b in zip(pdf["nodes"], pdf["bonus"]):
            best.setdefault(tuple(int(x) for x in nodes), int(b))
        rows = sorted(best)
        if len(rows) > 1:
            sim = _jaccard(rows)
            heads = []
            for group in _complete_link(1.0 - sim, 1.0 - jaccard):
                mean = sim[np.ix_(group, group)].mean(axis=1)
                top = [g for g, m in zip(group, mean) if m == mean.max()]
                heads.append(min(top))
            rows = [rows[i] for i in sorted(heads)]
            if len(rows) > keep:
                extra = np.array([best[r] for r in rows])
                rows = [rows[i] for i in _spread(_jaccard(rows), extra, keep)]
        head = {c: [pdf[c].iloc[0]] * len(rows) for c in cell}
        return pd.DataFrame({**head, "nodes": [list(r) for r in rows],
                             "pick": np.arange(1, len(rows) + 1, dtype=np.int32)})

    return src.groupBy(*cell).applyInPandas(pick, schema)


def prefix_size(n: int, threshold: float) -> int:
    """Edges of an n-edge path the prefix filter has to index."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i")
