"""Grouped cross-validation from cross-product sums.

An elastic net needs only the sums of products of its columns.  Spark adds them
up once per (group of rows that stay together); every training set of the nested
cross-validation is a sum of such blocks, so fits never see the rows and their
cost does not depend on the data size.

Missing values stay exact: a column enters as (value or 0, missing flag), from
which the sums for any fill value follow.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.columns import finite
from pathloom.operators.folds import grouped_folds
from pathloom.session import materialize, side_table

# fixed values: the hyper-parameter grid, 15 alphas (two a decade) x 8 mixing ratios
ALPHAS = tuple(10.0 ** (-6 + k / 2) for k in range(15))
L1_RATIOS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0)
DEFAULT_FIT = (0.01, 0.5)  # fixed value: used when a training set has one group only
TOLERANCE, MAX_SWEEPS = 1e-8, 200_000
TIE = 1e-12
UNROLLED = 16  # columns whose terms are written out; more of them go through arrays


def augmented(features: list[str], y: str) -> list[Column]:
    """[1, values with gaps as 0, gap flags, outcome] as doubles."""
    gap = {f: ~F.coalesce(finite(F.col(f)), F.lit(False)) for f in features}
    return [F.lit(1.0), *[F.when(gap[f], 0.0).otherwise(F.col(f).cast("double")) for f in features],
            *[gap[f].cast("double") for f in features], F.col(y).cast("double")]


def gram(df: DataFrame, keys: list[str], features: list[str], y: str, flush: int = 4096
         ) -> DataFrame:
    """(keys, idx, value): upper triangle of the cross-product matrix per group.

    Arrow batches are reduced with NumPy inside each partition before anything is
    shuffled, so one group may hold any share of the rows.
    """
    width = 2 * len(features) + 2
    iu = np.triu_indices(width)
    packed = df.select(*keys, F.array(*augmented(features, y)).alias("z"))
    schema = packed.select(*keys).schema.add("idx", "integer").add("value", "double")

    def reduce(batches):
        acc: dict[tuple, np.ndarray] = {}

        def emit():
            for k, m in acc.items():
                head = {c: [v] * len(iu[0]) for c, v in zip(keys, k)}
                yield pd.DataFrame({**head, "idx": np.arange(len(iu[0]), dtype=np.int32),
                                    "value": m[iu]})

        for pdf in batches:
            for k, part in pdf.groupby(keys, sort=False):
                z = np.vstack(part["z"].to_numpy())
                k = k if isinstance(k, tuple) else (k,)
                acc[k] = acc.get(k, 0.0) + z.T @ z
            if len(acc) > flush:
                yield from emit()
                acc.clear()
        yield from emit()

    return packed.mapInPandas(reduce, schema).groupBy(*keys, "idx").agg(
        F.sum("value").alias("value"))


def _square(values: np.ndarray, width: int) -> np.ndarray:
    m = np.zeros((width, width))
    iu = np.triu_indices(width)
    m[iu] = values
    return m + np.triu(m, 1).T


def _filled(m: np.ndarray, p: int, fill: np.ndarray) -> np.ndarray:
    """Cross products of [1, filled columns, y] from the augmented ones."""
    t = np.zeros((p + 2, 2 * p + 2))
    t[0, 0] = t[-1, -1] = 1.0
    for j in range(p):
        t[1 + j, 1 + j] = 1.0
        t[1 + j, 1 + p + j] = fill[j]
    return t @ m @ t.T


class Scaled:
    """Centred and scaled sums of a training set; constant columns are dropped."""

    def __init__(self, m: np.ndarray):
        n = m[0, 0]
        mean = m[0, 1:-1] / n
        var = np.maximum(np.diag(m)[1:-1] / n - mean**2, 0.0)
        self.n, self.mean, self.y_mean = n, mean, m[0, -1] / n
        self.keep = np.flatnonzero(var > 1e-14 * np.maximum(1.0, mean**2))
        self.scale = np.sqrt(var[self.keep])
        k = self.keep + 1
        c = m[np.ix_(k, k)] / n - np.outer(mean[self.keep], mean[self.keep])
        self.g = c / np.outer(self.scale, self.scale)
        self.c = (m[k, -1] / n - mean[self.keep] * self.y_mean) / self.scale

    def raw(self, beta: np.ndarray) -> np.ndarray:
        """[intercept, coefficients] on the unscaled columns."""
        out = np.zeros(len(self.mean) + 1)
        out[self.keep + 1] = beta / self.scale
        out[0] = self.y_mean - out[1:] @ self.mean
        return out


def elastic_nets(sets: list[Scaled], points: list[tuple[int, float, float]]
                 ) -> tuple[list[np.ndarray], int]:
    """Minima of 1/(2n)|y - Xb|^2 + alpha l1 |b|_1 + alpha (1 - l1)/2 |b|^2 for many problems.

    ``points`` are (index into ``sets``, alpha, l1).  Coordinate descent moves one coordinate
    of all open problems at a time; a problem closes when a sweep moves it no further.
    Returns the coefficients on the scaled columns and how many problems stayed open at the
    limit of sweeps.
    """
    p = max((len(s.mean) for s in sets), default=0)
    g, c = np.zeros((len(sets), p, p)), np.zeros((len(sets), p))
    for i, s in enumerate(sets):  # constant columns keep zeros and never move
        g[np.ix_([i], s.keep, s.keep)] = s.g
        c[i, s.keep] = s.c
    of = np.array([i for i, _, _ in points])
    lasso = np.array([a * r for _, a, r in points])
    ridge = np.array([a * (1.0 - r) for _, a, r in points])
    done = np.zeros((len(points), p))
    active, b, grad = np.arange(len(points)), np.zeros((len(points), p)), c[of]
    for _ in range(MAX_SWEEPS):
        if not len(active):
            break
        own, moved = of[active], np.zeros(len(active))
        for j in range(p):
            curve = g[own, j, j]
            pull = grad[:, j] + curve * b[:, j]
            bottom = curve + ridge[active]
            new = np.sign(pull) * np.maximum(np.abs(pull) - lasso[active], 0.0) / np.where(bottom > 0, bottom, 1.0)
            step = new - b[:, j]
            grad -= g[own, :, j] * step[:, None]
            b[:, j] = new
            np.maximum(moved, np.abs(step), out=moved)
        still = moved > TOLERANCE * np.maximum(1.0, np.abs(b).max(axis=1, initial=0.0))
        done[active] = b
        active, b, grad = active[still], b[still], grad[still]
    return [row[sets[i].keep] for row, i in zip(done, of)], len(active)


def elastic_net(s: Scaled, alpha: float, l1: float) -> np.ndarray:
    return elastic_nets([s], [(0, alpha, l1)])[0][0]


def sse(m: np.ndarray, coef: np.ndarray) -> float:
    """Squared error of [intercept, coefficients] on a set given by its sums."""
    w = np.append(-coef, 1.0)
    return float(max(w @ m @ w, 0.0))


def pick_best(rows: list[tuple[float, float, float]]) -> tuple[float, float]:
    """(alpha, ratio) of the least finite error; errors up to 1e-12 above it tie with it, and the
    strongest penalty of the tied ones wins (larger alpha, then larger ratio)."""
    table = np.array([r for r in rows if math.isfinite(r[0])])
    tied = table[table[:, 0] <= table[:, 0].min() + TIE, 1:]
    return tuple(map(float, tied[np.lexsort((tied[:, 1], tied[:, 0]))[-1]]))


def group_folds_within(groups: DataFrame, outer: DataFrame, group: str, n_inner: int) -> DataFrame:
    """Inner fold of every training group, per (repeat, outer fold): groupKFold by size."""
    sizes = groups.select(group, "size")
    out = None
    pairs = outer.select("repeat", "test_fold").distinct().orderBy("repeat", "test_fold").collect()
    for r in pairs:  # repeats x outer folds, a few dozen
        train = outer.where((F.col("repeat") == r["repeat"]) & (F.col("test_fold") != r["test_fold"]))
        part = grouped_folds(sizes.join(train.select(group), group, "left_semi"), group, 1, n_inner,
                             f"inner|{r['repeat']}|{r['test_fold']}")
        part = part.select(group, F.lit(r["repeat"]).alias("repeat"),
                           F.lit(r["test_fold"]).alias("outer_fold"), F.col("test_fold").alias("inner"))
        out = part if out is None else out.unionByName(part)
    return out


def hashed_inner_folds(outer: DataFrame, group: str, n_inner: int, n_outer: int, tag: str) -> DataFrame:
    """(repeat, outer_fold, group, inner): inner folds by hash, -1 marks the outer test groups.

    For many groups of similar size; :func:`group_folds_within` balances by size.
    """
    from pathloom.functions.columns import hash_mod

    each = outer.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(n_outer - 1))))
    inner = hash_mod(n_inner, tag, F.col("repeat"), F.col("outer_fold"), F.col(group)).cast("int")
    return each.select("repeat", "outer_fold", group, F.when(
        F.col("test_fold") == F.col("outer_fold"), -1).otherwise(inner).alias("inner"))


def outer_sets(outer: DataFrame, group: str, n_outer: int) -> DataFrame:
    """(repeat, outer_fold, group, inner) for fits without inner folds: -1 marks the outer test
    groups, 0 the others."""
    each = outer.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(n_outer - 1))))
    return each.select("repeat", "outer_fold", group, F.when(
        F.col("test_fold") == F.col("outer_fold"), -1).otherwise(0).alias("inner"))


def set_labels(assign: DataFrame, group: str) -> tuple[DataFrame, list[tuple[int, int]], int]:
    """(group, lab) with the inner label of the group in every (repeat, outer fold), -1 where it
    has none, one row a group and written once; those sets; the largest inner label."""
    seen = assign.groupBy("repeat", "outer_fold").agg(F.max("inner").alias("top")).collect()  # repeats x outer folds
    sets = sorted((r[0], r[1]) for r in seen)
    mine = lambda r, o: F.max(F.when((F.col("repeat") == r) & (F.col("outer_fold") == o), F.col("inner")))
    lab = side_table(assign.groupBy(group).agg(F.array(*[
        F.coalesce(mine(*s), F.lit(-1)).cast("int") for s in sets]).alias("lab")))
    return lab, sets, max((r["top"] for r in seen if r["top"] is not None), default=-1)


def fold_labels(assign: DataFrame, group: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(group, lab) with the inner label of the group in every (repeat, outer fold), and
    the list of those sets (repeats x outer folds)."""
    sets = sorted((r[0], r[1]) for r in assign.select("repeat", "outer_fold").distinct().collect())
    lab = assign.groupBy(group).agg(F.array_sort(F.collect_list(  # one entry per set
        F.struct("repeat", "outer_fold", "inner")))["inner"].alias("lab"))
    return lab, sets


def fold_grams(df: DataFrame, assign: DataFrame, group: str, features: list[str], y: str,
               labels: tuple | None = None) -> DataFrame:
    """(repeat, outer_fold, inner, idx, value): cross products of every fold block.

    A row adds to one block per (repeat, outer fold) inside its own partition;
    what is shuffled is partitions x blocks x columns^2, never rows or groups.
    ``labels`` are those of :func:`set_labels`, if they are there already.
    """
    lab, sets = labels[:2] if labels else fold_labels(assign, group)
    width = 2 * len(features) + 2
    iu = np.triu_indices(width)
    rows = df.select(group, F.array(*augmented(features, y)).alias("z")).join(
        lab if labels else side_table(lab), group).select("z", "lab")

    def reduce(batches):
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            z, lb = np.vstack(pdf["z"].to_numpy()), np.vstack(pdf["lab"].to_numpy())
            for s, (r, o) in enumerate(sets):
                for inner in np.unique(lb[:, s]):
                    part = z[lb[:, s] == inner]
                    k = (r, o, int(inner))
                    acc[k] = acc.get(k, 0.0) + part.T @ part
        for (r, o, i), m in acc.items():
            yield pd.DataFrame({"repeat": r, "outer_fold": o, "inner": i,
                                "idx": np.arange(len(iu[0]), dtype=np.int32), "value": m[iu]})

    return rows.mapInPandas(
        reduce, "repeat int, outer_fold int, inner int, idx int, value double").groupBy(
        "repeat", "outer_fold", "inner", "idx").agg(F.sum("value").alias("value"))


def _median_round(rows: DataFrame, edges: dict[int, np.ndarray], want: list[tuple], n_inner: int) -> list:
    """Where the wanted ranks fall among ``edges``; rows are counted by label and bucket first.

    ``want`` has (f, s, left_out, which, a, r): the r-th training value from ``a`` on, or, if r
    is None, the middle ones.  Gives (f, s, left_out, which, n, a, b, r): the value lies in
    [a, b) at r; b follows a where only one value is left.
    """
    n_sets, of = max(w[1] for w in want) + 1, {}
    for w in want:
        of.setdefault(w[:2], []).append(w[2:])

    def count(batches):
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            for f, part in pdf.groupby("f", sort=False):
                lb, nb = np.vstack(part["lab"].to_numpy()) + 1, len(edges[f]) + 1
                bucket = np.searchsorted(edges[f], part["x"].to_numpy(), side="right")
                m = acc.setdefault(f, np.zeros((n_sets, (n_inner + 1) * nb), np.int64))
                for s in range(n_sets):
                    m[s] += np.bincount(lb[:, s] * nb + bucket, minlength=m.shape[1])
        for f, m in acc.items():
            s, at = np.nonzero(m)
            yield pd.DataFrame({"f": f, "s": s, "label": at // (len(edges[f]) + 1) - 1,
                                "bucket": at % (len(edges[f]) + 1), "n": m[s, at]})

    def locate(key, pdf: pd.DataFrame) -> pd.DataFrame:
        f, s = int(key[0]), int(key[1])
        e, out = edges[f], []
        m = np.zeros((n_inner + 1, len(e) + 1), np.int64)
        m[pdf["label"] + 1, pdf["bucket"]] = pdf["n"]
        for left_out, which, a, r in of.get((f, s), []):
            c = m[1:].sum(axis=0) - (m[1 + left_out] if left_out >= 0 else 0)
            n = int(c.sum())
            if not n:
                continue
            for name, rank in [(which, r)] if r is not None else [("lo", (n - 1) // 2), ("hi", n // 2)]:
                start = 0 if a == -math.inf else int(np.searchsorted(e, a)) + 1
                upto = np.cumsum(c[start:])
                k = int(np.searchsorted(upto, rank, side="right"))
                rank -= int(upto[k - 1]) if k else 0
                k += start
                out.append((f, s, left_out, name, n, float(e[k - 1]) if k else -math.inf,
                            float(e[k]) if k < len(e) else math.inf, rank))
        return pd.DataFrame(out, columns=["f", "s", "left_out", "which", "n", "a", "b", "r"])

    return rows.mapInPandas(count, "f int, s int, label int, bucket int, n long").groupBy(
        "f", "s", "label", "bucket").agg(F.sum("n").alias("n")).groupBy("f", "s").applyInPandas(
        locate, "f int, s int, left_out int, which string, n long, a double, b double, r long").collect()


def fold_medians(df: DataFrame, assign: DataFrame, group: str, features: list[str], with_inner: bool,
                 labels: tuple | None = None) -> DataFrame:
    """Training medians per (repeat, outer fold, left-out inner fold; -1 = whole training set).

    A row belongs to many training sets and is never copied: the label of its group in every
    (repeat, outer fold) goes with it.  Tasks count rows by label and bucket between quantiles
    of the column; a round keeps the rows of the buckets that hold a median, until a bucket is
    one value.  There are several times as many buckets as medians, so every round sheds most
    rows.  To the driver come one row a median and the bucket bounds.  ``labels`` are those of
    :func:`set_labels`, if they are there already.
    """
    lab, sets, top = labels or set_labels(assign, group)
    schema = "repeat int, outer_fold int, left_out int, " + ", ".join(f"`{f}` double" for f in features)
    if top < 0:  # no inner fold: no training rows
        return df.sparkSession.createDataFrame([], schema)
    values = df.select(group, F.explode(F.array(*[
        F.struct(F.lit(i).alias("f"), F.when(finite(F.col(c)), F.col(c).cast("double")).alias("x"))
        for i, c in enumerate(features)])).alias("v")).select(group, "v.*").where("x is not null")
    rows, bare = values.join(lab, group).select("f", "x", "lab"), values
    want = [(f, s, o, "", -math.inf, None) for f in range(len(features)) for s in range(len(sets))
            for o in range(-1, top + 1 if with_inner else 0)]
    n_edges = max(256, 4 * 2 * len(sets) * (top + 2 if with_inner else 1))
    found: dict[tuple, float] = {}
    while want:
        cut = {r["f"]: np.array(r["e"]) for r in bare.groupBy("f").agg(F.percentile_approx(
            "x", [k / n_edges for k in range(n_edges + 1)], 4 * n_edges).alias("e")).collect()}
        bounds = {f: np.array([w[4] for w in want if w[0] == f and w[4] != -math.inf]) for f in cut}
        edges = {f: np.unique(np.concatenate([e, np.nextafter(e, math.inf), bounds[f]])) for f, e in cut.items()}
        got = _median_round(rows, edges, [w for w in want if w[0] in edges], top + 1)
        open_ = [r for r in got if r["b"] > np.nextafter(r["a"], math.inf)]
        found |= {(r["f"], r["s"], r["left_out"], r["which"]): r["a"] for r in got if r["b"] <= np.nextafter(r["a"], math.inf)}
        want = [(r["f"], r["s"], r["left_out"], r["which"], r["a"], r["r"]) for r in open_]
        if not want:
            break
        spans = sorted({(r["f"], r["a"], r["b"]) for r in open_})
        inside = F.lit(False)
        for f in edges:
            own = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for g, a, b in spans if g == f]
            if own:
                inside = inside | ((F.col("f") == f) & F.exists(F.array(*own), lambda t: (
                    F.col("x") >= t["a"]) & (F.col("x") < t["b"])))
        rows = bare = materialize(rows.where(inside))
    out: dict[tuple, list] = {}
    for f, s, o, which in found:
        if which == "lo":
            lo, hi = found[f, s, o, "lo"], found[f, s, o, "hi"]
            out.setdefault((s, o), [None] * len(features))[f] = lo + 0.5 * (hi - lo)
    return df.sparkSession.createDataFrame([(*map(int, sets[s]), o, *v) for (s, o), v in sorted(out.items())], schema)


def elastic_net_cv(df: DataFrame, assign: DataFrame, group: str, features: list[str], y: str,
                   alphas=ALPHAS, l1_ratios=L1_RATIOS) -> DataFrame:
    """Nested grouped cross-validation; one row per (repeat, outer_fold).

    Training medians, scaling and the grid search use the training groups only.
    The grid runs in one task per outer fold on matrices of the columns.  Returns the chosen
    (alpha, l1_ratio), inner RMSE, intercept and coefficients on the raw columns,
    fill values, and the test error from the test sums.
    """
    p = len(features)
    width = 2 * p + 2
    seen = df.agg(*[F.bool_or(~F.coalesce(finite(F.col(f)), F.lit(False))).alias(f)
                    for f in features]).first()
    gaps = [f for f in features if seen[f]]
    sums = fold_grams(df, assign, group, features, y)
    packed = sums.groupBy("repeat", "outer_fold", "inner").agg(
        F.array_sort(F.collect_list(F.struct("idx", "value")))["value"].alias("m"))
    n_groups = assign.where("inner >= 0").groupBy("repeat", "outer_fold").agg(
        F.count_distinct(group).alias("n_groups"))
    packed = packed.join(n_groups, ["repeat", "outer_fold"])
    if gaps:
        med = fold_medians(df, assign, group, gaps, True).groupBy("repeat", "outer_fold").agg(
            F.collect_list(F.struct("left_out", F.array(*[
                F.coalesce(F.col(f), F.lit(0.0)) if f in gaps else F.lit(0.0) for f in features])
                .alias("v"))).alias("fills"))
    else:
        med = packed.select("repeat", "outer_fold").distinct().withColumn(
            "fills", F.array().cast("array<struct<left_out:int,v:array<double>>>"))
    tasks = packed.join(med, ["repeat", "outer_fold"])
    schema = ("repeat int, outer_fold int, alpha double, l1_ratio double, inner_rmse double, "
              "n_train double, n_test double, test_sse double, coef array<double>, fill array<double>, "
              "not_converged int")

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        mats = {int(i): _square(np.asarray(v, dtype=float), width)
                for i, v in zip(pdf["inner"], pdf["m"])}
        fills = {int(r["left_out"]): np.asarray(r["v"], dtype=float) for r in pdf["fills"].iloc[0]}
        zero = np.zeros(p)
        inner = sorted(i for i in mats if i >= 0)
        whole, open_ = sum(mats[i] for i in inner), 0
        grid = [(a, l) for a in alphas for l in l1_ratios]
        if pdf["n_groups"].iloc[0] < 2 or len(inner) < 2:
            (alpha, l1), err = DEFAULT_FIT, float("nan")
        else:
            fill = [fills.get(i, zero) for i in inner]
            train = [Scaled(_filled(whole - mats[i], p, f)) for i, f in zip(inner, fill)]
            held = [_filled(mats[i], p, f) for i, f in zip(inner, fill)]
            fitted, open_ = elastic_nets(train, [(k, *g) for k in range(len(inner)) for g in grid])
            errors = [math.sqrt(sse(held[k // len(grid)], train[k // len(grid)].raw(b)) / held[k // len(grid)][0, 0])
                      for k, b in enumerate(fitted)]
            mean = np.reshape(errors, (len(inner), len(grid))).mean(axis=0)
            alpha, l1 = pick_best([(float(e), *g) for e, g in zip(mean, grid)])
            err = float(mean[grid.index((alpha, l1))])
        fill = fills.get(-1, zero)
        s = Scaled(_filled(whole, p, fill))
        coef = s.raw(elastic_net(s, alpha, l1))
        test = _filled(mats[-1], p, fill) if -1 in mats else np.zeros((p + 2, p + 2))
        return pd.DataFrame([(int(key[0]), int(key[1]), alpha, l1, err, float(s.n), float(test[0, 0]),
                              sse(test, coef), list(coef), list(fill), open_)],
                            columns=[c.split()[0] for c in schema.split(", ")])

    return tasks.groupBy("repeat", "outer_fold").applyInPandas(fit, schema)


def predict_oof(df: DataFrame, assign: DataFrame, fits: DataFrame, key: str, group: str,
                features: list[str], y: str) -> DataFrame:
    """Out-of-fold predictions (key, repeat, outer_fold, y_true, y_pred)."""
    test = assign.where("inner = -1").select("repeat", "outer_fold", group)
    coefs = side_table(fits.select("repeat", "outer_fold", "coef", "fill"))
    x = F.array(*[F.when(finite(F.col(f)), F.col(f).cast("double")) for f in features])
    j = df.select(key, group, F.col(y).cast("double").alias("y_true"), x.alias("x")).join(
        test, group).join(coefs, ["repeat", "outer_fold"])
    if len(features) <= UNROLLED:  # the same sum, compiled
        total = F.lit(0.0)
        for i in range(len(features)):
            total = total + F.coalesce(F.col("x")[i], F.col("fill")[i]) * F.col("coef")[i + 1]
    else:
        filled = F.zip_with("x", "fill", lambda a, b: F.coalesce(a, b))
        slopes = F.slice("coef", 2, len(features))
        total = F.aggregate(F.zip_with(filled, slopes, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    pred = F.element_at("coef", 1) + total
    return j.select(F.col(key).alias("sample_id"), "repeat", "outer_fold", group, "y_true",
                    pred.alias("y_pred"))


def fixed_fits(df: DataFrame, assign: DataFrame, chosen: DataFrame, group: str, features: list[str],
               y: str) -> DataFrame:
    """Refit every outer fold with hyper-parameters looked up in ``chosen``; gaps take the
    median of the fold's training groups."""
    p, width = len(features), 2 * len(features) + 2
    train = F.when(F.col("inner") >= 0, 0).otherwise(-1)  # inner folds have no say
    assign = assign.withColumn("inner", train)
    labels = set_labels(assign, group)
    m = fold_grams(df, assign, group, features, y, labels).where("inner >= 0").groupBy(
        "repeat", "outer_fold", "idx").agg(F.sum("value").alias("value")).groupBy(
        "repeat", "outer_fold").agg(
        F.array_sort(F.collect_list(F.struct("idx", "value")))["value"].alias("m"))
    j = m.join(chosen.select("repeat", "outer_fold", "alpha", "l1_ratio"), ["repeat", "outer_fold"])
    seen = df.agg(*[F.bool_or(~F.coalesce(finite(F.col(f)), F.lit(False))).alias(f) for f in features]).first()
    gaps = [f for f in features if seen[f]]
    if gaps:  # other columns need no fill
        med = fold_medians(df, assign, group, gaps, False, labels).select("repeat", "outer_fold", F.array(*[
            F.coalesce(F.col(f), F.lit(0.0)) if f in gaps else F.lit(0.0) for f in features]).alias("v"))
        j = j.join(med, ["repeat", "outer_fold"], "left")
    else:
        j = j.withColumn("v", F.lit(None).cast("array<double>"))

    def fit(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                fill = np.zeros(p) if r.v is None else np.asarray(r.v, dtype=float)
                s = Scaled(_filled(_square(np.asarray(r.m, dtype=float), width), p, fill))
                out.append((r.repeat, r.outer_fold, list(s.raw(elastic_net(s, r.alpha, r.l1_ratio))), list(fill)))
            yield pd.DataFrame(out, columns=["repeat", "outer_fold", "coef", "fill"])

    return j.mapInPandas(fit, "repeat int, outer_fold int, coef array<double>, fill array<double>")


# ---- balanced logistic regression, all folds at once -----------------------------------------


def train_scaling(df: DataFrame, folds: DataFrame, key: str, features: list[str], n_folds: int
                  ) -> DataFrame:
    """Mean and population spread of the training rows per (repeat, fold left out).

    Sums per fold come first; a training set is the total minus its fold.
    """
    x = df.join(folds, key)
    per = x.groupBy("repeat", "fold").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f).cast("double")).alias(f"s_{f}") for f in features],
        *[F.sum(F.col(f).cast("double") * F.col(f)).alias(f"q_{f}") for f in features])
    names = ["n", *[f"{k}_{f}" for k in "sq" for f in features]]
    left = per.withColumn("left_out", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).where(
        "fold <> left_out")
    t = left.groupBy("repeat", "left_out").agg(*[F.sum(c).alias(c) for c in names])
    return t.select("repeat", F.col("left_out").alias("fold"), F.col("n").alias("n_train"), *[
        e for f in features for e in (
            (F.col(f"s_{f}") / F.col("n")).alias(f"mean_{f}"),
            F.sqrt(F.greatest(F.col(f"q_{f}") / F.col("n")
                              - F.pow(F.col(f"s_{f}") / F.col("n"), 2), F.lit(0.0))).alias(f"sd_{f}"))])


def logistic_cv(df: DataFrame, folds: DataFrame, key: str, label: str, features: list[str],
                n_folds: int = 5, c: float = 1.0, max_iter: int = 30, tol: float = 1e-9) -> DataFrame:
    """L2 logistic regression (balanced classes, free intercept) for every (repeat, fold).

    Newton steps: each pass adds up gradient and Hessian of all fits at once over
    the Arrow batches of the rows; only p x p sums per fit reach the driver.
    Returns (repeat, fold, coef) on the raw columns, intercept first.
    """
    p = len(features)
    sc = {(r["repeat"], r["fold"]): r for r in train_scaling(df, folds, key, features, n_folds).collect()}
    fits = sorted(sc)  # repeats x folds
    mean = np.array([[sc[k][f"mean_{f}"] for f in features] for k in fits])
    sd = np.array([[sc[k][f"sd_{f}"] or 1.0 for f in features] for k in fits])
    joined = df.join(folds.groupBy(key).agg(F.map_from_entries(F.collect_list(
        F.struct("repeat", "fold"))).alias("f")), key)  # one entry per repeat
    rows = materialize(joined.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
                                     F.col(label).cast("int").alias("y"), F.array(*[
                                         F.element_at("f", F.lit(r)) for r in sorted({k[0] for k in fits})
                                     ]).alias("f")))
    reps = sorted({k[0] for k in fits})
    n_c = rows.select("y", F.posexplode("f").alias("r", "fold")).groupBy("r", "fold", "y").count().collect()
    size = {}
    for r in n_c:  # repeats x folds x 2
        for k in fits:
            if reps[r["r"]] == k[0] and r["fold"] != k[1]:
                size[(k, r["y"])] = size.get((k, r["y"]), 0) + r["count"]
    weight = np.array([[(size[(k, 0)] + size[(k, 1)]) / (2.0 * size[(k, cl)]) for cl in (0, 1)] for k in fits])
    beta = np.zeros((len(fits), p + 1))
    width = p + 1 + (p + 1) ** 2

    def passes(current):
        rep_at = {r: i for i, r in enumerate(reps)}
        where = [(rep_at[k[0]], k[1]) for k in fits]

        def run(batches):
            acc = np.zeros((len(fits), width))
            for pdf in batches:
                if not len(pdf):
                    continue
                x, f = np.vstack(pdf["x"].to_numpy()), np.vstack(pdf["f"].to_numpy())
                y = pdf["y"].to_numpy()
                for i, (ri, fold) in enumerate(where):
                    on = f[:, ri] != fold
                    z = np.column_stack([np.ones(on.sum()), (x[on] - mean[i]) / sd[i]])
                    mu = 1.0 / (1.0 + np.exp(-(z @ current[i])))
                    w = weight[i][y[on]]
                    acc[i, :p + 1] += z.T @ (w * (mu - y[on]))
                    acc[i, p + 1:] += (z.T @ (z * (w * mu * (1 - mu))[:, None])).ravel()
            yield pd.DataFrame({"fit": np.repeat(np.arange(len(fits)), width),
                                "idx": np.tile(np.arange(width), len(fits)), "v": acc.ravel()})
        return run

    penal = np.diag([0.0] + [1.0 / c] * p)
    for _ in range(max_iter):
        got = rows.mapInPandas(passes(beta), "fit long, idx long, v double").groupBy("fit", "idx").agg(
            F.sum("v").alias("v")).collect()  # fits x (p+1)(p+2) numbers
        acc = np.zeros((len(fits), width))
        for r in got:
            acc[r["fit"], r["idx"]] = r["v"]
        moved = 0.0
        for i in range(len(fits)):
            g = acc[i, :p + 1] + penal @ beta[i]
            h = acc[i, p + 1:].reshape(p + 1, p + 1) + penal
            step = np.linalg.solve(h, g)
            beta[i] -= step
            moved = max(moved, np.abs(step).max())
        if moved < tol:
            break
    out = []
    for i, k in enumerate(fits):
        raw = beta[i, 1:] / sd[i]
        out.append((int(k[0]), int(k[1]), [float(beta[i, 0] - raw @ mean[i]), *map(float, raw)]))
    return df.sparkSession.createDataFrame(out, "repeat int, fold int, coef array<double>")


def predict_logistic(df: DataFrame, folds: DataFrame, fits: DataFrame, key: str, label: str,
                     features: list[str]) -> DataFrame:
    """Out-of-fold probabilities (key, repeat, fold, label, score)."""
    j = df.select(key, label, F.array(*[F.col(f).cast("double") for f in features]).alias("x")).join(
        folds.select(key, "repeat", "fold"), key).join(side_table(fits), ["repeat", "fold"])
    eta = F.element_at("coef", 1) + F.aggregate(
        F.zip_with("x", F.slice("coef", 2, len(features)), lambda a, b: a * b), F.lit(0.0),
        lambda s, v: s + v)
    return j.select(key, "repeat", "fold", label, (1.0 / (1.0 + F.exp(-eta))).alias("score"))


def forest_importance(df: DataFrame, label: str, features: list[str], trees: int = 500, seed: int = 0
                      ) -> DataFrame:
    """Random-forest importances with balanced class weights (pyspark.ml)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # two classes
    total = sum(n.values())
    w = F.when(F.col(label) == 1, total / (2.0 * n[1])).otherwise(total / (2.0 * n[0]))
    vec = VectorAssembler(inputCols=features, outputCol="features").transform(
        df.select(*[F.col(f).cast("double").alias(f) for f in features],
                  F.col(label).cast("double").alias("label"), w.alias("w")))
    model = RandomForestClassifier(numTrees=trees, weightCol="w", seed=seed).fit(vec)
    imp = model.featureImportances.toArray()
    return df.sparkSession.createDataFrame(
        [(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")


# ---- one model per path length -----------------------------------------------------------------


def per_length_fits(sub: DataFrame, length: str, group: str, features: list[str], y: str,
                    n_folds: int = 5, min_rows: int = 50, min_groups: int = 5,
                    alphas=ALPHAS, l1_ratios=L1_RATIOS) -> DataFrame:
    """Elastic net per length: grouped outer folds, inner search, full and median-fold coefficients.

    Lengths with too few rows or groups are left out.
    """
    from pathloom.functions.columns import hash_mod

    ok = sub.groupBy(length).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("g")).where(
        (F.col("n") >= min_rows) & (F.col("g") >= min_groups)).select(length)
    df = materialize(sub.join(ok, length, "left_semi").withColumn(
        "outer", hash_mod(n_folds, "outer", F.col(group)).cast("int")).withColumn(
        "inner", hash_mod(n_folds, "inner", F.col(group)).cast("int")))
    p, width = len(features), 2 * len(features) + 2
    m = gram(df, [length, "outer", "inner"], features, y).groupBy(length, "outer", "inner").agg(
        F.array_sort(F.collect_list(F.struct("idx", "value")))["value"].alias("m"))
    schema = ("length int, n double, alpha double, l1_ratio double, oof_r2 double, "
              "coef array<double>, median_coef array<double>")

    def search(parts: dict[int, np.ndarray]) -> tuple[float, float]:
        if len(parts) < 2:
            return DEFAULT_FIT
        whole, held = sum(parts.values()), list(parts.values())
        train, grid = [Scaled(whole - h) for h in held], [(a, r) for a in alphas for r in l1_ratios]
        fitted, _ = elastic_nets(train, [(k, *g) for k in range(len(held)) for g in grid])
        err = [sse(held[k // len(grid)], train[k // len(grid)].raw(b)) / max(held[k // len(grid)][0, 0], 1.0)
               for k, b in enumerate(fitted)]
        mean = np.reshape(err, (len(held), len(grid))).mean(axis=0)
        return pick_best([(float(e), *g) for e, g in zip(mean, grid)])

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cells = {(int(o), int(i)): _filled(_square(np.asarray(v, dtype=float), width), p, np.zeros(p))
                 for o, i, v in zip(pdf["outer"], pdf["inner"], pdf["m"])}
        total = sum(cells.values())
        coefs, err = [], 0.0
        for o in sorted({k[0] for k in cells}):
            test = sum(v for k, v in cells.items() if k[0] == o)
            train = total - test
            if train[0, 0] < 2:
                continue
            inner: dict[int, np.ndarray] = {}
            for (oo, i), v in cells.items():
                if oo != o:
                    inner[i] = inner.get(i, 0.0) + v
            s = Scaled(train)
            raw = s.raw(elastic_net(s, *search(inner)))
            coefs.append(raw)
            err += sse(test, raw)
        by_inner: dict[int, np.ndarray] = {}
        for (_, i), v in cells.items():
            by_inner[i] = by_inner.get(i, 0.0) + v
        best = search(by_inner)
        s = Scaled(total)
        sst = total[-1, -1] - total[0, -1] ** 2 / total[0, 0]
        return pd.DataFrame([(int(key[0]), float(total[0, 0]), *best, 1.0 - err / sst if sst > 0 else None,
                              list(s.raw(elastic_net(s, *best))), list(np.median(coefs, axis=0)))],
                            columns=[c.split()[0] for c in schema.split(", ")])

    return m.groupBy(length).applyInPandas(fit, schema)
