"""Path sets to feature vectors: summary statistics, ordered basis, endpoint block."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.columns import arr_mean, arr_sum, arr_var_pop, finite, slope
from pathloom.session import broadcast_if_small

METRICS = ("nav", "rout", "search", "comm")
STATS = ("mean", "std", "min", "max", "first", "last", "slope")
DEGREES = 4
MAX_EDGES = 20  # fixed value: longest path of the one-hot block and the basis


def _spread(groups: DataFrame, cell: list[str], names: list[str]) -> DataFrame:
    """Median and interquartile range of every column per cell.

    Path sets are rank samples, so a group is at most the sample size.
    """
    q = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    agg = groups.groupBy(*cell).agg(
        *[F.percentile(F.when(finite(n), F.col(n)), q).alias(n) for n in names])
    out = []
    for n in names:
        out += [F.col(n)[1].alias(f"{n}_med"), (F.col(n)[2] - F.col(n)[0]).alias(f"{n}_iqr")]
    return agg.select(*cell, *out)


def path_stats(metric: str) -> dict[str, Column]:
    a = F.col(metric)
    return {
        "mean": arr_mean(a), "std": F.sqrt(arr_var_pop(a)), "min": F.array_min(a),
        "max": F.array_max(a), "first": F.element_at(a, 1), "last": F.element_at(a, -1),
        "slope": slope(a)}


def blind_stats(paths: DataFrame, cell: list[str]) -> DataFrame:
    """56 features per cell: 7 statistics x 4 metrics, each as median and IQR."""
    cols = {f"{m}_{s}": c for m in METRICS for s, c in path_stats(m).items()}
    flat = paths.select(*cell, *[c.alias(n) for n, c in cols.items()])
    return _spread(flat, cell, list(cols))


def basis(L: int) -> np.ndarray:
    """Legendre polynomials of degree 0..min(3, L-1) at L even positions on [-1, 1]."""
    z = np.zeros(1) if L == 1 else np.linspace(-1.0, 1.0, L)
    return np.polynomial.legendre.legvander(z, min(DEGREES - 1, L - 1))


def basis_weights(max_len: int = MAX_EDGES) -> list[list[list[float]]]:
    """weights[L-1][q][s]: least-squares coefficient q as a weighted sum of the values.

    The pseudo-inverse depends on the length only; degrees a short path cannot
    carry have zero weights.
    """
    out = []
    for L in range(1, max_len + 1):
        w = np.zeros((DEGREES, L))
        p = np.linalg.pinv(basis(L))
        w[: p.shape[0]] = p
        out.append(w.tolist())
    return out


def _double_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def basis_coefficient(metric: str, q: int, max_len: int) -> Column:
    table = F.array(*[_double_array(w[q]) for w in basis_weights(max_len)])
    w = F.element_at(table, F.size(metric))
    return F.aggregate(F.zip_with(F.col(metric), w, lambda x, y: x * y), F.lit(0.0),
                       lambda s, t: s + t)


def legendre_features(paths: DataFrame, cell: list[str], max_len: int = MAX_EDGES) -> DataFrame:
    """32 features per cell: 4 ordered-basis coefficients x 4 metrics, median and IQR."""
    names = {f"ob_{m}_p{q}": basis_coefficient(m, q, max_len)
             for m in METRICS for q in range(DEGREES)}
    flat = paths.select(*cell, *[c.alias(n) for n, c in names.items()])
    return _spread(flat, cell, list(names))


def endpoint_block(cells: DataFrame, edges: DataFrame, max_len: int = MAX_EDGES) -> DataFrame:
    """Length one-hot and the four metrics of the direct (seed, endpoint) pair."""
    pair = broadcast_if_small(edges.select(
        F.col("u").alias("seed"), F.col("v").alias("endpoint"),
        *[F.col(m).alias(f"ep_{m}") for m in METRICS]))
    hot = [F.when(F.col("L") == k, 1.0).otherwise(0.0).alias(f"L_{k}")
           for k in range(1, max_len + 1)]
    return cells.join(pair, ["seed", "endpoint"], "left").select(
        "seed", "endpoint", "L", *hot, *[f"ep_{m}" for m in METRICS])


def assemble(cells: DataFrame, blocks: list[DataFrame], cell: list[str]) -> DataFrame:
    """Feature blocks side by side; a cell without paths gets NULL features."""
    out = cells
    for b in blocks:
        out = out.join(b, cell, "left")
    return out


def mode_share() -> Column:
    """Mean over metrics of largest / total along the path, undefined parts left out."""
    parts = F.array(*[F.when(arr_sum(m) > 0, F.greatest(F.array_max(m), F.lit(0.0)) / arr_sum(m))
                      for m in METRICS])
    known = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, arr_sum(known) / F.size(known))


def mode_label(share: Column) -> Column:
    return (F.when(share > 2.0 / 3.0, "routing").when(share < 1.0 / 3.0, "diffusion")
            .otherwise("partial"))


def mode_shares(paths: DataFrame, cell: list[str]) -> DataFrame:
    """Share of routing, diffusion and partial paths per cell."""
    m = paths.select(*cell, mode_label(F.round(mode_share(), 9)).alias("mode"))
    n = F.count(F.lit(1))
    return m.groupBy(*cell).agg(*[
        (F.count_if(F.col("mode") == k) / n).alias(f"share_{k}")
        for k in ("routing", "diffusion", "partial")])


def coverage(kept: DataFrame, universe: DataFrame) -> DataFrame:
    """Distinct endpoints kept / distinct endpoints known, per seed."""
    a = kept.groupBy("seed").agg(F.countDistinct("endpoint").alias("n_kept"))
    b = universe.groupBy("seed").agg(F.countDistinct("endpoint").alias("n_all"))
    return b.join(a, "seed", "left").select(
        "seed", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), "n_all",
        (F.coalesce("n_kept", F.lit(0)) / F.col("n_all")).alias("coverage"))


def network_dummies(col: Column, networks: list, prefix: str) -> list[Column]:
    return [F.when(col == n, 1.0).otherwise(0.0).alias(f"{prefix}{n}") for n in networks]


def feature_qc(features: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: missing, infinite, spread after median fill; one pass plus medians."""
    med = features.agg(*[F.percentile(F.when(finite(c), F.col(c)), 0.5).alias(c)
                         for c in cols]).first()
    stats = features.agg(F.array(*[F.struct(
        F.lit(c).alias("feature"),
        F.count_if(F.col(c).isNull() | F.isnan(c)).alias("n_missing"),
        F.count_if(F.abs(F.col(c)) == float("inf")).alias("n_infinite"),
        F.var_pop(F.when(finite(c), F.col(c)).otherwise(F.lit(med[c]))).alias("var"))
        for c in cols]).alias("a"))
    return stats.select(F.explode("a").alias("s")).select(
        "s.feature", "s.n_missing", "s.n_infinite",
        (F.round("s.var", 12) == 0).alias("zero_variance"))


# 14 feature variants: path set, edge order, feature block
VARIANTS = {
    f"{block}_{source}{'_' + order if order else ''}": (source, order, block)
    for source, orders in (("all", ("", "order", "edge")), ("selected", ("", "order", "edge")),
                           ("matched", ("",)))
    for order in orders for block in ("c6", "c8r")
}
