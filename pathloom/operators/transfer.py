"""Training on one domain and half of another: roles, balanced logistic fits, scores.

A training set is named by (direction, variant, repeat): ``OOS`` trains on a share of
the source domain and half of the target domain and tests the rest of both; ``LETTER`` trains
on all of the source and half of the target, and pools the source with the unseen half.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.columns import hash_hex
from pathloom.operators.ordered import row_position
from pathloom.session import materialize, side_table

VARIANTS = ("OOS", "LETTER")
SOURCE_SHARE = 0.8  # fixed value: share of the source domain that OOS trains on
MAX_STEPS, TOLERANCE = 100, 1e-9
SET = ["direction", "variant", "repeat"]


def transfer_roles(df: DataFrame, key: str, domain: str, pair: tuple[str, str], repeats: int, tag: str) -> DataFrame:
    """(key, domain, direction, variant, repeat, role) for every row of the two domains.

    Roles are train_source, train_target, test_source and test_target.  Every repeat puts the
    rows of a domain into another hash order; the first ones train.
    """
    each = df.where(F.col(domain).isin(*pair)).select(
        key, domain, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    placed = row_position(each.withColumn("h", hash_hex(tag, F.col("repeat"), F.col(key))),
                          ["repeat", domain], ["h", key])
    n = side_table(df.groupBy(domain).agg(F.count(F.lit(1)).alias("n")))
    runs = F.array(*[F.struct(F.lit(f"{a}_to_{b}").alias("direction"), F.lit(v).alias("variant"), F.lit(a).alias("source"))
                     for a, b in (pair, pair[::-1]) for v in VARIANTS])
    j = placed.join(n, domain).select(key, domain, "repeat", "pos", "n", F.inline(runs))
    source = F.col(domain) == F.col("source")
    cut = F.when(~source, F.expr("n div 2")).when(F.col("variant") == "LETTER", F.col("n")).otherwise(
        F.bround(F.lit(SOURCE_SHARE) * F.col("n")).cast("bigint"))
    role = F.concat(F.when(F.col("pos") <= cut, "train_").otherwise("test_"), F.when(source, "source").otherwise("target"))
    return j.select(key, domain, *SET, role.alias("role"))


def _with_sets(df: DataFrame, roles: DataFrame, key: str, label: str, features: list[str]):
    """(rows with x, y and their roles by set, the sets): one row of ``df`` carries all its roles."""
    sets = [tuple(r) for r in roles.select(*SET).distinct().orderBy(*SET).collect()]  # a few dozen
    of = roles.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*SET, "role"))).alias("r"))
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.select(key, F.col(label).cast("int").alias("y"), x.alias("x")).join(of, key).select(
        key, "x", "y", F.transform("r", lambda r: r["role"]).alias("roles"),
        F.transform("r", lambda r: r["role"].startswith("train")).alias("train"))
    return materialize(rows), sets


def balanced_logistic(rows: DataFrame, n_sets: int, models: dict[str, list[int]], c: float = 1.0) -> DataFrame:
    """L2 logistic regression (balanced classes, free intercept, scaled columns) of every set and model.

    ``rows`` has x, y and train (a flag for each set); ``models`` names the columns of each
    model.  All fits advance together: a pass over the rows adds up loss, gradient and Hessian
    of each inside the tasks, and only those sums move.  A Newton step that doesn't lower
    the loss is halved.  Returns (set, model, coef on the raw columns with the intercept first,
    steps, converged, n_train, n_pos).
    """
    p = max(max(m) for m in models.values()) + 1
    on = lambda s: F.element_at("train", s + 1)
    x = lambda j: F.element_at("x", j + 1)
    stats = rows.agg(*[e for s in range(n_sets) for e in (
        F.count_if(on(s) & (F.col("y") == 0)).alias(f"n0_{s}"), F.count_if(on(s) & (F.col("y") == 1)).alias(f"n1_{s}"),
        *[f(F.when(on(s), x(j))).alias(f"{k}_{s}_{j}") for j in range(p) for k, f in (("m", F.avg), ("d", F.stddev_pop))])]).first()
    count = np.array([[stats[f"n{y}_{s}"] for y in (0, 1)] for s in range(n_sets)], float)
    mean = np.array([[stats[f"m_{s}_{j}"] for j in range(p)] for s in range(n_sets)], float)
    spread = np.array([[stats[f"d_{s}_{j}"] or 1.0 for j in range(p)] for s in range(n_sets)], float)
    if (count == 0).any():
        raise ValueError("a training set lacks one of the classes")
    weight = count.sum(axis=1, keepdims=True) / (2.0 * count)
    fits = [(s, m) for s in range(n_sets) for m in models]
    size = [len(models[m]) + 1 for _, m in fits]
    beta = [np.zeros(k) for k in size]
    step, loss = [np.zeros(k) for k in size], np.full(len(fits), np.inf)
    steps, open_ = np.zeros(len(fits), int), set(range(len(fits)))

    def passes(which, current):
        def run(batches):
            acc = {i: np.zeros(1 + size[i] + size[i] ** 2) for i in which}
            for pdf in batches:
                if not len(pdf):
                    continue
                xs, tr, y = np.vstack(pdf["x"].to_numpy()), np.vstack(pdf["train"].to_numpy()), pdf["y"].to_numpy()
                for i in which:
                    s, m = fits[i]
                    here = tr[:, s]
                    z = np.column_stack([np.ones(here.sum()), ((xs[here] - mean[s]) / spread[s])[:, models[m]]])
                    eta, yy = z @ current[i], y[here]
                    mu, w = 1.0 / (1.0 + np.exp(-eta)), weight[s][yy]
                    acc[i][0] += np.sum(w * (np.logaddexp(0.0, eta) - yy * eta))
                    acc[i][1:1 + size[i]] += z.T @ (w * (mu - yy))
                    acc[i][1 + size[i]:] += (z.T @ (z * (w * mu * (1 - mu))[:, None])).ravel()
            for i, a in acc.items():
                yield pd.DataFrame({"fit": i, "idx": np.arange(len(a)), "v": a})
        return run

    for _ in range(MAX_STEPS):
        if not open_:
            break
        which = sorted(open_)
        sums = {i: np.zeros(1 + size[i] + size[i] ** 2) for i in which}
        for r in rows.mapInPandas(passes(which, beta), "fit long, idx long, v double").groupBy("fit", "idx").agg(
                F.sum("v").alias("v")).collect():  # fits x columns^2 numbers
            sums[r["fit"]][r["idx"]] = r["v"]
        for i in which:
            k, slopes = size[i], beta[i] * np.r_[0.0, np.ones(size[i] - 1)]
            now = sums[i][0] + slopes @ slopes / (2 * c)
            if now > loss[i] + 1e-12 * abs(loss[i]):  # too far: half way back
                step[i] = step[i] / 2
                beta[i] = beta[i] + step[i]
                continue
            loss[i], grad = now, sums[i][1:1 + k] + slopes / c
            hess = sums[i][1 + k:].reshape(k, k) + np.diag(np.r_[0.0, np.full(k - 1, 1.0 / c)])
            step[i] = np.linalg.solve(hess, grad)
            if np.abs(step[i]).max() < TOLERANCE:
                open_.discard(i)
                continue
            beta[i] = beta[i] - step[i]
            steps[i] += 1
    out = []
    for i, (s, m) in enumerate(fits):
        raw = beta[i][1:] / spread[s][models[m]]
        out.append((s, m, [float(beta[i][0] - raw @ mean[s][models[m]]), *map(float, raw)], int(steps[i]), i not in open_,
                    int(count[s].sum()), int(count[s][1])))
    return rows.sparkSession.createDataFrame(
        out, "set int, model string, coef array<double>, steps int, converged boolean, n_train long, n_pos long")


def transfer_fits(df: DataFrame, roles: DataFrame, key: str, label: str, features: list[str],
                  models: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(fits, scores): the logistic fit of every (direction, variant, repeat, model), and the
    probability each gives to every row with the row's role there."""
    rows, sets = _with_sets(df, roles, key, label, features)
    named = rows.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(sets)], "set int, direction string, variant string, repeat int")
    of = {m: [features.index(f) for f in fs] for m, fs in models.items()}
    fits = side_table(balanced_logistic(rows, len(sets), of).join(F.broadcast(named), "set"))
    places = F.create_map(*[v for m, js in of.items() for v in (F.lit(m), F.array(*[F.lit(j) for j in js]))])
    each = rows.select(key, "y", "x", F.posexplode("roles").alias("set", "role")).join(
        fits.select("set", *SET, "model", "coef"), "set")
    eta = F.element_at("coef", 1) + F.aggregate(F.zip_with(
        F.transform(places[F.col("model")], lambda j: F.get("x", j)), F.slice("coef", 2, F.size("coef") - 1),
        lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return fits, each.select(key, *SET, "model", "role", F.col("y").alias("label"), (1.0 / (1.0 + F.exp(-eta))).alias("score"))


def pooled_roles(scores: DataFrame) -> DataFrame:
    """Rows that a variant is judged on: the test rows, for LETTER the source rows too."""
    return scores.where(F.col("role").startswith("test") | ((F.col("variant") == "LETTER") & (F.col("role") == "train_source")))


def gradient_check(df: DataFrame, scores: DataFrame, fits: DataFrame, key: str, features: list[str],
                   models: dict[str, list[str]], c: float = 1.0) -> DataFrame:
    """Largest gradient of every fit, recomputed from the rows, the scores and the coefficients alone:
    zero at the optimum.  Columns are scaled by the training rows of the set."""
    train = scores.where(F.col("role").startswith("train")).join(df.select(key, *features), key)
    keys = [*SET, "model"]
    scale = train.groupBy(*SET).agg(
        F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"),
        *[f(F.col(x).cast("double")).alias(f"{k}_{x}") for x in features for k, f in (("m", F.avg), ("d", F.stddev_pop))])
    scale = side_table(scale)
    miss = (F.col("n0") + F.col("n1")) / (2.0 * F.when(F.col("label") == 1, F.col("n1")).otherwise(F.col("n0"))) * (
        F.col("score") - F.col("label"))
    z = lambda x: (F.col(x).cast("double") - F.col(f"m_{x}")) / F.coalesce(F.nullif(F.col(f"d_{x}"), F.lit(0.0)), F.lit(1.0))
    g = train.join(scale, SET).groupBy(*keys).agg(
        F.sum(miss).alias("g0"), *[F.sum(miss * z(x)).alias(f"g_{x}") for x in features],
        *[F.first(F.coalesce(F.nullif(F.col(f"d_{x}"), F.lit(0.0)), F.lit(1.0))).alias(f"s_{x}") for x in features])
    g = g.join(fits.select(*keys, "coef", "n_train", "n_pos", "converged"), keys)
    parts = [F.abs("g0")]
    for x in features:
        at = F.create_map(*[v for m, fs in models.items() for v in (F.lit(m), F.lit(fs.index(x) + 2 if x in fs else 0))])[F.col("model")]
        parts.append(F.when(at > 0, F.abs(F.col(f"g_{x}") + F.element_at("coef", F.greatest(at, F.lit(1))) * F.col(f"s_{x}") / c)).otherwise(0.0))
    return g.select(*keys, "n_train", "n_pos", "converged", F.greatest(*parts).alias("gradient"))
