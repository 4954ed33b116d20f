"""Arms refitted at the hyper-parameters that another arm chose, and a check of any elastic net."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.columns import finite
from pathloom.operators import models as Mo
from pathloom.session import materialize, side_table

FIT = ["repeat", "outer_fold"]


def conditional_fits(df: DataFrame, assign: DataFrame, group: str, y: str, base: tuple[str, list[str]],
                     arms: dict[str, list[str]]) -> DataFrame:
    """(arm, repeat, outer_fold, alpha, l1_ratio, coef, fill): the base arm by nested
    cross-validation, every other arm at the base arm's choice of the same (repeat, fold)."""
    name, columns = base
    own = materialize(Mo.elastic_net_cv(df, assign, group, columns, y))
    chosen = side_table(own.select(*FIT, "alpha", "l1_ratio"))
    out = own.select(F.lit(name).alias("arm"), *FIT, "alpha", "l1_ratio", "coef", "fill")
    for arm, features in arms.items():
        fits = Mo.fixed_fits(df, assign, chosen, group, features, y).join(chosen, FIT)
        out = out.unionByName(fits.select(F.lit(arm).alias("arm"), *FIT, "alpha", "l1_ratio", "coef", "fill"))
    return materialize(out)


def elastic_net_violations(df: DataFrame, assign: DataFrame, fits: DataFrame, group: str, features: list[str], y: str) -> DataFrame:
    """(repeat, outer_fold, n_train, violation): how far every fit (coef on the raw columns, fill,
    alpha, l1_ratio) is from the conditions of a minimum, recomputed from the rows.

    On columns scaled by the training rows a nonzero coefficient b needs a slope of
    alpha l1 sign(b) + alpha (1 - l1) b, a zero one at most alpha l1 in size, and the residuals
    have mean zero.  Constant columns have no say.
    """
    x = F.array(*[F.when(finite(F.col(f)), F.col(f).cast("double")) for f in features])
    rows = df.select(group, F.col(y).cast("double").alias("y"), x.alias("x")).join(
        assign.where("inner >= 0").select(*FIT, group), group).join(side_table(fits.select(*FIT, "coef", "fill")), FIT)
    rows = rows.withColumn("x", F.zip_with("x", "fill", lambda a, b: F.coalesce(a, b)))
    eta = F.element_at("coef", 1) + F.aggregate(F.zip_with(
        "x", F.slice("coef", 2, len(features)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = rows.select(*FIT, (F.col("y") - eta).alias("r"), "x")
    size = rows.groupBy(*FIT).agg(F.count(F.lit(1)).alias("n_train"), F.avg("r").alias("bias"))
    slope = rows.select(*FIT, "r", F.posexplode("x").alias("j", "v")).groupBy(*FIT, "j").agg(
        F.covar_pop("v", "r").alias("cov"), F.stddev_pop("v").alias("sd"), F.avg("v").alias("mean"))
    b = fits.select(*FIT, "alpha", "l1_ratio", F.posexplode(F.slice("coef", 2, len(features))).alias("j", "b"))
    j = slope.join(b, [*FIT, "j"]).where(F.col("sd") > 1e-7 * F.greatest(F.lit(1.0), F.abs("mean")))
    g, scaled = F.col("cov") / F.col("sd"), F.col("b") * F.col("sd")
    lasso, ridge = F.col("alpha") * F.col("l1_ratio"), F.col("alpha") * (1 - F.col("l1_ratio"))
    off = F.when(scaled == 0, F.greatest(F.abs(g) - lasso, F.lit(0.0))).otherwise(F.abs(g - lasso * F.signum(scaled) - ridge * scaled))
    worst = j.groupBy(*FIT).agg(F.max(off).alias("worst"))
    return size.join(worst, FIT, "left").select(*FIT, "n_train", F.greatest(F.abs("bias"), F.coalesce("worst", F.lit(0.0))).alias("violation"))
