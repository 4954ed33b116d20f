"""Feature displacement, similarity of targets, group tests, clustering of targets.

Rows are reduced to one vector per target by aggregation; what follows works on
targets, whose number is checked before anything is held in one place.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.columns import anomaly_index, clip, cosine, hash_hex
from pathloom.functions.special import f_tail_udf, normal_two_sided_udf, t_two_sided_udf
from pathloom.operators.ordered import row_position, scan, value_ranks
from pathloom.session import broadcast_if_small, is_small, materialize

ALPHA = 0.242  # fixed value: displacement share for every target
NORMAL_INDEX = 0.2  # fixed value: below it a path counts as normal
TARGET_LIMIT = 500  # targets whose vectors may sit in one expression or task
MIN_ROWS = 50  # fixed value: paths a region needs to be a target


def select_targets(rows: DataFrame, region: str, rules: dict[str, Column], min_rows: int = MIN_ROWS,
                   first: int = 10) -> DataFrame:
    """Regions with enough rows, the first ones per rule (largest first, then by name).

    A region may serve one rule only.
    """
    n = rows.groupBy(region).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    tagged = n.withColumn("target_type", F.explode(F.array_compact(F.array(*[
        F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))))
    # regions are names, not rows: a rule's window holds distinct regions
    w = Window.partitionBy("target_type").orderBy(F.desc("n"), region)
    picked = materialize(tagged.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= first))
    twice = picked.groupBy(region).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"region {twice[0][region]} matches several rules")
    return picked.select("target_type", region, "n", "pos")


def mean_vectors(rows: DataFrame, target: str, cols: list[str]) -> DataFrame:
    return rows.groupBy(target).agg(F.count(F.lit(1)).alias("n"),
                                    *[F.avg(c).alias(c) for c in cols])


def _literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def displace(x: Column, ref: Column, alpha: float = ALPHA) -> Column:
    return (1.0 - alpha) * x + alpha * ref


def displacement(rows: DataFrame, target: str, cols: list[str], reference: list[float],
                 alpha: float = ALPHA, min_rows: int = 10) -> DataFrame:
    """Correction rate, similarity after displacement, and specificity per target.

    Displacement is linear, so the displaced mean follows from the mean: one
    aggregation over the rows.
    """
    ref = _literal(reference)
    own = F.array(*[F.col(c) for c in cols])
    m = rows.groupBy(target).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in cols]).alias("mean"),
        F.avg((anomaly_index(own, ref) < NORMAL_INDEX).cast("int")).alias("normal"))
    m = m.where(F.col("n") >= min_rows).withColumn(
        "moved", F.zip_with("mean", ref, lambda x, r: displace(x, r, alpha)))
    before, after = anomaly_index("mean", ref), anomaly_index("moved", ref)
    return m.select(
        target, "n", before.alias("index_before"), after.alias("index_after"),
        F.when(before > 0, clip((before - after) / before, 0.0, 1.0)).otherwise(0.0).alias("cr"),
        cosine("moved", ref).alias("sr"), (1.0 - F.col("normal")).alias("si"))


def pairwise(vectors: DataFrame, key: str, vec: str, limit: int = TARGET_LIMIT) -> DataFrame:
    """(a, b, dot, na, nb) for all ordered pairs of targets.

    The full matrix is the result.  Up to ``limit`` targets it is computed
    against an array literal; beyond, by an equi-join on the dimension.
    """
    vectors = materialize(vectors.select(key, vec))
    if is_small(vectors, limit):
        rows = vectors.collect()  # at most ``limit`` rows
        table = F.array(*[F.struct(F.lit(r[key]).alias("b"), _literal(r[vec]).alias("y"))
                          for r in rows])
        j = vectors.select(F.col(key).alias("a"), F.col(vec).alias("x"), F.explode(table).alias("o"))
        prod = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0),
                                        lambda acc, v: acc + v)
        x, y = F.col("x"), F.col("o.y")
        return j.select("a", F.col("o.b").alias("b"), prod(x, y).alias("dot"),
                        prod(x, x).alias("na"), prod(y, y).alias("nb"))
    long = vectors.select(F.col(key).alias("k"), F.posexplode(vec).alias("i", "x"))
    norm = long.groupBy("k").agg(F.sum(F.col("x") * F.col("x")).alias("n"))
    dots = long.select(F.col("k").alias("a"), "i", "x").join(
        long.select(F.col("k").alias("b"), "i", F.col("x").alias("y")), "i").groupBy("a", "b").agg(
        F.sum(F.col("x") * F.col("y")).alias("dot"))
    return dots.join(norm.toDF("a", "na"), "a").join(norm.toDF("b", "nb"), "b")


def cosine_matrix(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", F.when((F.col("na") == 0) | (F.col("nb") == 0), 0.95).otherwise(
        F.col("dot") / (F.sqrt("na") * F.sqrt("nb"))).alias("cosine"))


def distance_matrix(pairs: DataFrame) -> DataFrame:
    sq = F.col("na") + F.col("nb") - 2.0 * F.col("dot")
    return pairs.select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(
        F.sqrt(F.greatest(sq, F.lit(0.0)))).alias("dist"))


def zscore_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sample z-score of every column over all rows of a small target table."""
    s = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
               *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]).first()
    return df.select(*[c for c in df.columns if c not in cols], *[
        ((F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"])).alias(c) for c in cols])


def ranking_text(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """Names by falling value joined with ' > ' (one entry per class, so short lists)."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("m"), F.col(name).alias("k")))),
        lambda s: s["k"].cast("string")), " > ").alias("ranking"))


# ---- group tests from sums ---------------------------------------------------------


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way F, sums of squares and eta squared; rows collapse to one sum per group."""
    x = F.col(value)
    g = df.groupBy(group).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    n, k = F.sum("n"), F.count(F.lit(1))
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / n
    within = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    r = g.agg(n.alias("n"), k.alias("k"), between.alias("ss_between"), within.alias("ss_within"),
              ((between / (k - 1)) / (within / (n - k))).alias("f"),
              (between / (between + within)).alias("eta_sq"))
    return r.withColumn("p", f_tail_udf("f", (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")))


def permanova(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Pseudo-F on Euclidean distances, from per-dimension sums."""
    long = df.select(group, F.posexplode(vec).alias("i", "x")).withColumn(
        "x", F.col("x").cast("double"))
    g = long.groupBy(group, "i").agg(F.count("x").alias("n"), F.sum("x").alias("s"),
                                     F.sum(F.col("x") * F.col("x")).alias("q"))
    per_dim = g.groupBy("i").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("w"),
        (F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")).alias("t"))
    n, k, w, t = F.max("n"), F.max("k"), F.sum("w"), F.sum("t")
    return per_dim.agg(n.alias("n"), k.alias("k"),
                       (((t - w) / (k - 1)) / (w / (n - k))).alias("pseudo_f"),
                       ((t - w) / t).alias("r2"))


def manova(df: DataFrame, group: str, cols: list[str]) -> dict:
    """Wilks, Pillai, Hotelling-Lawley and the F approximation to Wilks' lambda.

    Spark sums the cross products per group; only p x p matrices reach the driver.
    """
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    g = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)],
        *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"q{i}_{j}") for i, j in pairs])
    within_expr = [F.sum(F.col(f"q{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n"))
                   .alias(f"w{i}_{j}") for i, j in pairs]
    total_expr = [(F.sum(f"q{i}_{j}") - F.sum(f"s{i}") * F.sum(f"s{j}") / F.sum("n"))
                  .alias(f"t{i}_{j}") for i, j in pairs]
    r = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), *within_expr, *total_expr).first()
    w, t = np.zeros((p, p)), np.zeros((p, p))
    for i, j in pairs:
        w[i, j] = w[j, i] = r[f"w{i}_{j}"]
        t[i, j] = t[j, i] = r[f"t{i}_{j}"]
    n, k = r["n"], r["k"]
    h = t - w
    lam = float(np.linalg.det(w) / np.linalg.det(t))
    roots = np.real(np.linalg.eigvals(np.linalg.pinv(w) @ h))
    df_h, df_e = k - 1, n - k
    s = np.sqrt((p * p * df_h * df_h - 4) / (p * p + df_h * df_h - 5)) if p * p + df_h * df_h > 5 else 1.0
    m = df_e + df_h - (p + df_h + 1) / 2
    d1, d2 = p * df_h, m * s - p * df_h / 2 + 1
    root = lam ** (1 / s)
    return {"n": int(n), "k": int(k), "wilks": lam, "pillai": float(np.sum(roots / (1 + roots))),
            "hotelling": float(np.sum(roots)), "f": float((1 - root) / root * d2 / d1),
            "df1": float(d1), "df2": float(d2)}


def two_group_stats(df: DataFrame, group: str, a, b, value: str) -> DataFrame:
    """Welch t with its degrees of freedom, Cohen d, U and rank-biserial r of a against b.

    U counts for group a; the rank-biserial sign follows the other group's U, as in
    the published tables.  Two-sided p-values: Welch's, and that of U by the normal
    approximation with corrections for ties and continuity.
    """
    sub = df.where(F.col(group).isin(a, b)).select((F.col(group) == F.lit(a)).alias("is_a"), value)
    counted = sub.groupBy(value).agg(F.count_if("is_a").alias("na"), F.count_if(~F.col("is_a")).alias("nb"))
    ranks = value_ranks(sub, [], value).select(value, "avg_rank")
    j = counted.join(ranks, value)
    x = F.col(value)
    s = j.agg(F.sum("na").alias("n1"), F.sum("nb").alias("n2"),
              F.sum(F.col("na") * x).alias("s1"), F.sum(F.col("nb") * x).alias("s2"),
              F.sum(F.col("na") * x * x).alias("q1"), F.sum(F.col("nb") * x * x).alias("q2"),
              F.sum(F.col("na") * F.col("avg_rank")).alias("r1"),
              F.sum(F.pow((F.col("na") + F.col("nb")).cast("double"), 3) - (F.col("na") + F.col("nb"))).alias("ties"))
    s = s.select("n1", "n2", "ties", (F.col("s1") / F.col("n1")).alias("mean1"),
                 (F.col("s2") / F.col("n2")).alias("mean2"),
                 ((F.col("q1") - F.col("s1") * F.col("s1") / F.col("n1")) / (F.col("n1") - 1)).alias("v1"),
                 ((F.col("q2") - F.col("s2") * F.col("s2") / F.col("n2")) / (F.col("n2") - 1)).alias("v2"),
                 (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0).alias("u"))
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"))
                    / (F.col("n1") + F.col("n2") - 2))
    diff = F.col("mean1") - F.col("mean2")
    both, n = F.col("n1") * F.col("n2"), F.col("n1") + F.col("n2")
    far = F.greatest(F.abs(F.col("u") - both / 2.0) - 0.5, F.lit(0.0)) / F.sqrt(
        both / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1.0))))
    out = s.select(
        "n1", "n2", "mean1", "mean2", far.alias("__z"), (diff / F.sqrt(e1 + e2)).alias("welch_t"),
        ((e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1)))
        .alias("welch_df"),
        F.when(pooled > 0, diff / pooled).alias("cohens_d"), "u",
        (1.0 - 2.0 * F.col("u") / (F.col("n1") * F.col("n2"))).alias("rank_biserial"))
    return out.withColumns({"welch_p": t_two_sided_udf("welch_t", "welch_df"), "u_p": normal_two_sided_udf("__z")}).drop("__z")


def mann_whitney_exact(n1: int, n2: int, u: float) -> float:
    """Two-sided exact p of U without ties, counting rank sums for small groups."""
    counts = np.zeros(n1 * n2 + 1)
    counts[0] = 1.0
    for i in range(1, n2 + 1):  # Gaussian binomial by repeated multiplication and division
        top = counts.copy()
        for v in range(n1 + i, n1 * n2 + 1):
            top[v] = counts[v] - counts[v - n1 - i]
        for v in range(i, n1 * n2 + 1):
            top[v] += top[v - i]
        counts = top
    low = min(u, n1 * n2 - u)
    return float(min(1.0, 2.0 * counts[: int(np.floor(low)) + 1].sum() / counts.sum()))


def class_mean_ci(df: DataFrame, group: str, value: str, level: float = 0.975) -> DataFrame:
    from pathloom.functions.special import t_quantile_udf

    s = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                              F.stddev_samp(value).alias("sd"))
    s = s.withColumn("se", F.col("sd") / F.sqrt("n")).withColumn(
        "t", F.when(F.col("n") > 1, t_quantile_udf(F.lit(level), (F.col("n") - 1).cast("double"))))
    return s.select(group, "n", "mean", "sd", "se", (F.col("mean") - F.col("t") * F.col("se")).alias("ci_low"),
                    (F.col("mean") + F.col("t") * F.col("se")).alias("ci_high"))


# ---- label enumeration and permutation over targets -------------------------------------


def labelings(spark, n: int, first: int = 2, second: int = 2) -> DataFrame:
    """All ways to put n targets into classes of sizes first / second / rest.

    (id, cls ARRAY<INT>); grown by exploding choices, one label at a time.
    """
    rows = spark.range(1).select(F.array().cast("array<int>").alias("cls"))
    used = lambda c: F.size(F.filter("cls", lambda v: v == c))
    for _ in range(n):
        room = F.array_compact(F.array(
            F.when(used(0) < first, F.lit(0)), F.when(used(1) < second, F.lit(1)),
            F.when(used(2) < n - first - second, F.lit(2))))
        rows = rows.select(F.col("cls"), F.explode(room).alias("c")).select(
            F.array_append("cls", F.col("c")).alias("cls"))
    return rows


def labeling_f(values: list[float], cls: str = "cls") -> Column:
    """One-way F of three classes over a short list of target values."""
    v = _literal(values)
    n = len(values)
    mean = float(np.mean(values))
    parts = []
    for c in range(3):
        inside = F.transform(F.filter(F.arrays_zip(v.alias("v"), F.col(cls).alias("c")),
                                      lambda s: s["c"] == c), lambda s: s["v"])
        size = F.size(inside)
        total = F.aggregate(inside, F.lit(0.0), lambda a, x: a + x)
        sq = F.aggregate(inside, F.lit(0.0), lambda a, x: a + x * x)
        parts.append((size * (total / size - mean) * (total / size - mean), sq - total * total / size))
    between, within = sum(p[0] for p in parts), sum(p[1] for p in parts)
    return (between / 2.0) / (within / (n - 3))


def exact_label_test(spark, values: list[float], observed: list[int]) -> DataFrame:
    """Share of all labelings with an F at least the observed one (identity included)."""
    if len(values) > 16:
        raise ValueError("enumeration is meant for at most 16 targets")
    first, second = observed.count(0), observed.count(1)
    obs = spark.range(1).select(F.array(*[F.lit(c) for c in observed]).alias("cls")).select(
        labeling_f(values).alias("f")).first()["f"]
    s = labelings(spark, len(values), first, second).select(labeling_f(values).alias("f"))
    return s.agg(F.count(F.lit(1)).alias("n_perm"),
                 F.count_if(F.round("f", 9) >= F.round(F.lit(obs), 9)).alias("n_extreme")).select(
        F.lit(obs).alias("stat_obs"), (F.col("n_extreme") / F.col("n_perm")).alias("p_exact"),
        "n_perm", "n_extreme")


def random_label_test(targets: DataFrame, key: str, cls: str, value: str, draws: int, tag: str
                      ) -> DataFrame:
    """Permutation test of the ANOVA F over targets: (extreme + 1) / (draws + 1), null moments.

    A draw deals the class labels out again in hash order; a window group is one
    draw's list of targets.
    """
    if not is_small(targets, TARGET_LIMIT):
        raise ValueError("label permutation works on targets, not on rows")
    spots = targets.select(F.row_number().over(Window.orderBy(key)).alias("i"), F.col(cls).alias("c"))
    base = targets.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    w = Window.partitionBy("draw").orderBy(hash_hex(tag, F.col("draw"), F.col(key)), key)
    dealt = base.withColumn("i", F.row_number().over(w)).join(broadcast_if_small(spots), "i")
    x = F.col(value)
    g = dealt.groupBy("draw", "c").agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    n, k = F.sum("n"), F.count(F.lit(1))
    bet = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / n
    wit = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    null = g.groupBy("draw").agg(((bet / (k - 1)) / (wit / (n - k))).alias("f"))
    obs = anova(targets, cls, value).first()["f"]
    return null.agg(
        F.lit(obs).alias("observed"), F.avg("f").alias("null_mean"), F.stddev_pop("f").alias("null_sd"),
        ((F.count_if(F.round("f", 9) >= F.round(F.lit(obs), 9)) + 1) / F.lit(draws + 1)).alias("p"))


# ---- clustering of targets ---------------------------------------------------------------


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index from the contingency counts."""
    cell = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    both = cell.agg(pairs("n").alias("p"), F.sum("n").alias("n")).first()
    pa = cell.groupBy(a).agg(F.sum("n").alias("m")).agg(pairs("m").alias("p")).first()["p"]
    pb = cell.groupBy(b).agg(F.sum("n").alias("m")).agg(pairs("m").alias("p")).first()["p"]
    n = both["n"]
    expected = pa * pb / (n * (n - 1) / 2.0)
    top = (pa + pb) / 2.0
    value = (both["p"] - expected) / (top - expected) if top != expected else 1.0
    return df.sparkSession.createDataFrame([(int(n), float(value))], "n long, ari double")


def silhouette(dist: DataFrame, labels: DataFrame, key: str, cluster: str) -> DataFrame:
    """Silhouette per target; the own-cluster mean includes the zero self-distance."""
    la = labels.select(F.col(key).alias("a"), F.col(cluster).alias("ca"))
    lb = labels.select(F.col(key).alias("b"), F.col(cluster).alias("cb"))
    m = dist.join(la, "a").join(lb, "b").groupBy("a", "ca", "cb").agg(F.avg("dist").alias("d"))
    s = m.groupBy("a").agg(F.min(F.when(F.col("ca") == F.col("cb"), F.col("d"))).alias("own"),
                           F.min(F.when(F.col("ca") != F.col("cb"), F.col("d"))).alias("other"))
    return s.select("a", F.when(F.greatest("own", "other") > 0, (F.col("other") - F.col("own"))
                                / F.greatest("own", "other")).otherwise(0.0).alias("silhouette"))


def _dimension(vectors: DataFrame, vec: str) -> int:
    return vectors.agg(F.max(F.size(vec))).first()[0] or 0


def _square_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def kmeans_targets(vectors: DataFrame, key: str, vec: str, k: int = 3, restarts: int = 500,
                   iterations: int = 200, tag: str = "kmeans") -> DataFrame:
    """Best of many k-means restarts: (key, cluster, inertia), clusters by their first key.

    All restarts advance together, one aggregation a round; a restart whose centres stand
    still leaves the loop.  A restart begins at the ``k`` targets with the least hash.  The
    centres (restarts x k rows) are broadcast; targets stay where they are.
    """
    points = materialize(vectors.select(F.col(key).alias("p"), F.col(vec).alias("x")))
    dim = _dimension(points, "x")
    every = points.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    first = Window.partitionBy("r").orderBy(hash_hex(tag, F.col("r"), F.col("p")), "p")
    centres = materialize(every.withColumn("c", F.row_number().over(first) - 1).where(F.col("c") < k).select("r", "c", "x"))

    def assigned(now: DataFrame) -> DataFrame:
        table = now.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("t"))
        best = F.array_min(F.transform("t", lambda q: F.struct(
            _square_distance(F.col("x"), q["x"]).alias("d"), q["c"].alias("c"))))
        return points.crossJoin(F.broadcast(table)).select("r", "p", "x", best.alias("b")).select(
            "r", "p", "x", "b.c", "b.d")

    still, open_ = None, centres
    for _ in range(iterations):
        mean = assigned(open_).groupBy("r", "c").agg(F.array(*[
            F.avg(F.element_at("x", i + 1)) for i in range(dim)]).alias("m"))
        moved = materialize(open_.join(mean, ["r", "c"], "left").select(
            "r", "c", F.coalesce("m", "x").alias("x"), (~F.coalesce(F.col("m") == F.col("x"), F.lit(True))).alias("moves")))
        going = moved.groupBy("r").agg(F.bool_or("moves").alias("moves"))
        moved = moved.drop("moves").join(going, "r")
        done = moved.where(~F.col("moves")).drop("moves")
        still = done if still is None else still.unionByName(done)
        open_ = moved.where("moves").drop("moves")
        if open_.isEmpty():
            break
    ended = assigned(materialize(still.unionByName(open_)))
    inertia = ended.groupBy("r").agg(F.round(F.sum("d"), 9).alias("inertia"))
    best = inertia.agg(F.min(F.struct("inertia", "r")).alias("b")).select("b.*")
    rows = materialize(ended.join(F.broadcast(best), "r"))
    order = rows.groupBy("c").agg(F.min("p").alias("f")).withColumn(
        "cluster", F.row_number().over(Window.orderBy("f")) - 1)  # k rows
    return rows.join(F.broadcast(order), "c").select(F.col("p").alias(key), "cluster", "inertia")


def ward(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """Ward merges of the targets: (left_id, right_id, height, size, cophenetic_r).

    Targets are numbered by key, merged clusters from there on.  Every merge is one round on
    the table of squared distances between open clusters (the matrix is the method's state);
    the driver only sees which two clusters merge.  Ties go to the smallest ids.
    """
    points = vectors.select(F.col(key).alias("k"), F.col(vec).alias("x"))
    n = points.count()
    points = materialize(points.withColumn("id", F.row_number().over(Window.orderBy("k")) - 1))
    other = points.select(F.col("id").alias("b"), F.col("x").alias("y"))
    apart = materialize(points.withColumnRenamed("id", "a").join(other, F.col("a") < F.col("b")).select(
        "a", "b", _square_distance(F.col("x"), F.col("y")).alias("d")))
    start, size, members = apart, {i: 1 for i in range(n)}, points.select(F.col("id").alias("c"), F.col("id").alias("leaf"))
    merges, joined = [], None
    for new in range(n, 2 * n - 1):
        low = apart.agg(F.min(F.struct("d", "a", "b")).alias("m")).first()["m"]
        i, j, d = low["a"], low["b"], low["d"]
        height, weight = float(np.sqrt(d)), size[i] + size[j]
        merges.append((i, j, height, weight))
        pair = members.where(F.col("c") == i).select(F.col("leaf").alias("p")).join(
            members.where(F.col("c") == j).select(F.col("leaf").alias("q"))).select(
            F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.lit(height).alias("h"))
        joined = pair if joined is None else joined.unionByName(pair)
        gone = lambda c: F.col(c).isin(i, j)
        rest = F.when(gone("a"), F.col("b")).otherwise(F.col("a"))
        own = F.when(F.coalesce(F.when(gone("a"), F.col("a")), F.col("b")) == i, size[i]).otherwise(size[j])
        count = F.create_map(*[F.lit(v) for kv in size.items() for v in kv])[F.col("m")]
        touched = apart.where(gone("a") != gone("b")).select(rest.alias("m"), own.alias("own"), "d").groupBy("m").agg(
            F.sum((F.col("own") + count) * F.col("d")).alias("s"))
        touched = touched.select(F.col("m").alias("a"), F.lit(new).alias("b"),
                                 ((F.col("s") - count * d) / (count + weight)).alias("d"))
        apart = materialize(apart.where(~gone("a") & ~gone("b")).unionByName(touched))
        members = materialize(members.withColumn("c", F.when(gone("c"), F.lit(new)).otherwise(F.col("c"))))
        size = {c: v for c, v in size.items() if c not in (i, j)} | {new: weight}
        joined = materialize(joined)
    out = vectors.sparkSession.createDataFrame(merges, "left_id int, right_id int, height double, size int")
    if joined is None:
        return out.withColumn("cophenetic_r", F.lit(None).cast("double"))
    r = start.join(joined, ["a", "b"]).agg(F.corr(F.sqrt("d"), F.col("h")).alias("cophenetic_r"))
    return out.crossJoin(F.broadcast(r))


def pca(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Components and explained ratios from the covariance matrix Spark sums up."""
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    r = df.agg(*[F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    c = np.zeros((p, p))
    for i, j in pairs:
        c[i, j] = c[j, i] = r[f"c{i}_{j}"]
    w, v = np.linalg.eigh(c)
    order = np.argsort(w)[::-1]
    return v[:, order].T, w[order] / w.sum()


# ---- correlations ------------------------------------------------------------------------


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation; ranks come from distributed counts."""
    rx = value_ranks(df, [], x).select(x, F.col("avg_rank").alias("rx"))
    ry = value_ranks(df, [], y).select(y, F.col("avg_rank").alias("ry"))
    # repeated (x, y) pairs collapse before they meet the ranks
    c = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("m")).join(rx, x).join(ry, y)
    m = F.col("m").cast("double")
    def corr(a, b):
        n, sa, sb = F.sum(m), F.sum(m * a), F.sum(m * b)
        cov = F.sum(m * a * b) - sa * sb / n
        return cov / F.sqrt((F.sum(m * a * a) - sa * sa / n) * (F.sum(m * b * b) - sb * sb / n))
    return c.agg(F.sum("m").alias("n"), corr(F.col(x), F.col(y)).alias("pearson"),
                 corr(F.col("rx"), F.col("ry")).alias("spearman"))


def kendall(targets: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Kendall tau-b over rows; equal (x, y) pairs are counted once with their number.

    Two distinct values of y part at one bit of their ranks.  Each bit makes groups of rows
    that agree in the bits above; in the order of x a running count of the zeros and ones
    before a row gives the pairs that part there.  That is rows x bits, never pairs of rows."""
    v = materialize(targets.groupBy(F.col(x).alias("x0"), F.col(y).alias("y0")).agg(
        F.count(F.lit(1)).cast("double").alias("m")))
    ranks = materialize(row_position(v.select("y0").distinct(), [], ["y0"], "rank").withColumn("rank", F.col("rank") - 1))
    bits = max(1, ((ranks.agg(F.max("rank")).first()[0] or 0)).bit_length())
    part = v.join(ranks, "y0").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    one = F.getbit("rank", F.col("level")) == 1
    at = part.groupBy("level", F.expr("shiftright(rank, level + 1)").alias("above"), "x0").agg(
        F.sum(F.when(~one, F.col("m")).otherwise(0.0)).alias("m0"), F.sum(F.when(one, F.col("m")).otherwise(0.0)).alias("m1"))
    run = scan(materialize(at), ["level", "above"], ["x0"], {"c0": ("sum", F.col("m0")), "c1": ("sum", F.col("m1"))})
    balance = run.agg(F.coalesce(F.sum(F.col("m1") * (F.col("c0") - F.col("m0")) - F.col("m0") * (F.col("c1") - F.col("m1"))),
                                 F.lit(0.0)).alias("s"))
    n = targets.agg(F.count(F.lit(1)).cast("double").alias("n"))
    untied = lambda c: v.groupBy(c).agg(F.sum("m").alias("m")).agg(
        F.sum(F.col("m") * F.col("m")).alias(f"q{c}"))
    row = balance.join(n).join(untied("x0")).join(untied("y0"))  # one row each
    pairs = lambda q: (F.col("n") * F.col("n") - F.col(q)) / 2.0
    return row.select((F.col("s") / F.sqrt(pairs("qx0") * pairs("qy0"))).alias("tau"))
