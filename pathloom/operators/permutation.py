"""Exact permutation tests of targets: every way to deal the class labels, from group sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.similarity import labelings
from pathloom.session import broadcast_if_small, is_small, materialize

MAX_TARGETS = 16  # three classes of 16 targets have some two million labelings


def labeling_sums(targets: DataFrame, key: str, cls: str, vec: str) -> DataFrame:
    """(labeling, observed, c, i, n, s): count and sum of each class and dimension, per labeling.

    ``targets`` has one row a target: its name, class 0 / 1 / 2 and vector of numbers.  The
    labelings keep the sizes of the classes.  Dimensions are centred on their mean first, so
    that squares of the sums do not cancel.  A target without a class or vector is left out,
    NULL entries of a vector are an error.
    """
    rows = materialize(targets.where(F.col(cls).isNotNull() & F.col(vec).isNotNull()).select(key, cls, vec))
    if not is_small(rows, MAX_TARGETS):
        raise ValueError(f"enumeration is meant for at most {MAX_TARGETS} targets")
    named = sorted((r[key], r[cls], [float(v) for v in r[vec]]) for r in rows.collect())
    seen = [c for _, c, _ in named]
    if set(seen) != {0, 1, 2} or len({k for k, _, _ in named}) < len(named):
        raise ValueError("three classes 0, 1, 2 and one row a target are needed")
    spark = targets.sparkSession
    mean = [sum(v) / len(named) for v in zip(*(x for _, _, x in named))]
    flat = spark.createDataFrame([(t, i, x - mean[i]) for t, (_, _, xs) in enumerate(named) for i, x in enumerate(xs)],
                                 "t int, i int, x double")
    ways = labelings(spark, len(named), seen.count(0), seen.count(1))
    ways = ways.select(F.array_join("cls", "").alias("labeling"), F.posexplode("cls").alias("t", "c"))
    return ways.join(broadcast_if_small(flat), "t").groupBy("labeling", "c", "i").agg(
        F.count("x").alias("n"), F.sum("x").alias("s")).withColumn(
        "observed", F.col("labeling") == "".join(map(str, seen)))


def permanova_exact(targets: DataFrame, key: str, cls: str, vec: str) -> DataFrame:
    """Pseudo-F on Euclidean distances and its exact p: the share of all labelings with an F at
    least the observed one (9 decimals, the observed labeling included).

    Sums of squares within follow from the total, which no labeling changes.
    """
    sums = labeling_sums(targets, key, cls, vec)
    total = targets.where(F.col(cls).isNotNull()).select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(
        (F.var_pop("x") * F.count("x")).alias("t")).agg(F.sum("t").alias("total"))
    between = sums.groupBy("labeling", "observed").agg(
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"),
        F.sum(F.when(F.col("i") == 0, F.col("n"))).alias("n"))
    f = between.crossJoin(F.broadcast(total)).select(  # one row
        "observed", F.round((F.col("between") / 2) / ((F.col("total") - F.col("between")) / (F.col("n") - 3)), 9).alias("f"))
    return _share(f, [], "f").withColumnRenamed("stat_obs", "pseudo_f")


def contrast_exact(targets: DataFrame, key: str, cls: str, vec: str, pairs: list[tuple[int, int]]) -> DataFrame:
    """Mean difference of two classes in each dimension and its exact two-sided p over all labelings."""
    mean = F.col("s") / F.col("n")
    wide = labeling_sums(targets, key, cls, vec).groupBy("labeling", "observed", "i").agg(
        *[F.max(F.when(F.col("c") == c, mean)).alias(f"m{c}") for c in range(3)])
    each = wide.select("observed", "i", F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"m{a}") - F.col(f"m{b}"), 9).alias("d"))
        for a, b in pairs])).alias("p")).select("observed", "i", "p.*")
    return _share(each, ["i", "a", "b"], "d")


def _share(draws: DataFrame, keys: list[str], stat: str) -> DataFrame:
    draws = materialize(draws)
    obs = draws.where("observed").select(*keys, F.col(stat).alias("stat_obs"))
    both = draws.join(F.broadcast(obs), keys) if keys else draws.crossJoin(F.broadcast(obs))  # one row a dimension and pair
    return both.groupBy(*keys, "stat_obs").agg(
        F.count(F.lit(1)).alias("n_perm"), F.count_if(F.abs(stat) >= F.abs("stat_obs")).alias("n_extreme")).withColumn(
        "p_exact", F.col("n_extreme") / F.col("n_perm"))
