"""Fit quality and contrasts from sums, never from collected predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sufficient_stats(oof: DataFrame, keys: list[str]) -> DataFrame:
    y, p = F.col("y_true"), F.col("y_pred")
    return oof.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"),
        F.sum((y - p) * (y - p)).alias("sse"))


def r2_from_sums(n, sy, syy, sse):
    sst = syy - sy * sy / n
    return F.when((n >= 3) & (sst > 0), 1.0 - sse / sst)


def metric_block(oof: DataFrame, keys: list[str]) -> DataFrame:
    """R2, RMSE, MAE, Pearson, calibration slope and intercept per group.

    NULL with fewer than three rows or a constant outcome; correlation and
    calibration also with a constant prediction.
    """
    y, p = F.col("y_true"), F.col("y_pred")
    n = F.count(F.lit(1))
    enough = n >= 3
    varies_y = enough & (F.max(y) > F.min(y))
    varies = varies_y & (F.max(p) > F.min(p))
    sst = F.sum(y * y) - F.sum(y) * F.sum(y) / n
    return oof.groupBy(*keys).agg(
        n.alias("n"),
        F.when(varies_y, 1.0 - F.sum((y - p) * (y - p)) / sst).alias("r2"),
        F.when(enough, F.sqrt(F.avg((y - p) * (y - p)))).alias("rmse"),
        F.when(enough, F.avg(F.abs(y - p))).alias("mae"),
        F.when(varies, F.corr(y, p)).alias("pearson"),
        F.when(varies, F.regr_slope(y, p)).alias("cal_slope"),
        F.when(varies, F.regr_intercept(y, p)).alias("cal_intercept"))


def repeat_r2(oof: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over repeats of the pooled R2; repeats without an R2 are left out."""
    s = sufficient_stats(oof, [*keys, "repeat"])
    r = s.withColumn("r2", r2_from_sums(F.col("n"), F.col("sy"), F.col("syy"), F.col("sse")))
    return r.groupBy(*keys).agg(F.avg("r2").alias("r2"), F.count("r2").alias("n_repeats"))


def sample_level(oof: DataFrame, keys: list[str]) -> DataFrame:
    """Mean prediction per sample over repeats, then the metric block."""
    m = oof.groupBy(*keys, "sample_id").agg(F.min("y_true").alias("y_true"),
                                            F.avg("y_pred").alias("y_pred"))
    return metric_block(m, keys)


def median_over_repeats(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Column medians over the repeats of a key (a group is one key's few repeats)."""
    return df.groupBy(*keys).agg(*[F.percentile(c, 0.5).alias(c) for c in cols])


def repeats_positive(oof: DataFrame, a: str, b: str) -> DataFrame:
    """R2 of two arms per repeat, their difference, and how many repeats favour ``a``."""
    s = sufficient_stats(oof.where(F.col("arm").isin(a, b)), ["arm", "repeat"])
    r = s.withColumn("r2", r2_from_sums(F.col("n"), F.col("sy"), F.col("syy"), F.col("sse")))
    per = r.groupBy("repeat").agg(F.min(F.when(F.col("arm") == a, F.col("r2"))).alias("r2_a"),
                                  F.min(F.when(F.col("arm") == b, F.col("r2"))).alias("r2_b"))
    return per.agg(F.avg("r2_a").alias("r2_a"), F.avg("r2_b").alias("r2_b"),
                   F.avg(F.col("r2_a") - F.col("r2_b")).alias("delta"),
                   F.count_if(F.col("r2_a") > F.col("r2_b")).alias("repeats_positive"),
                   F.count(F.lit(1)).alias("n_repeats"))


def contrasts(block: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Differences of R2, RMSE and MAE between arms of a metric block (one row per arm)."""
    spark = block.sparkSession
    p = spark.createDataFrame(pairs, "a string, b string")
    a = block.select(F.col("arm").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("r2", "rmse", "mae")])
    b = block.select(F.col("arm").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("r2", "rmse", "mae")])
    return p.join(a, "a").join(b, "b").select(
        "a", "b", *[(F.col(f"{c}_a") - F.col(f"{c}_b")).alias(f"d_{c}") for c in ("r2", "rmse", "mae")])
