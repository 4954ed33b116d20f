"""Long and wide prediction frames, fixed key lists, averaged arms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.validation import KEY


def oof_wide(oof: DataFrame, arms: list[str]) -> DataFrame:
    """One row per key with a ``<arm>_pred`` column; the arm list is fixed, so no extra scan."""
    return oof.groupBy(*KEY).agg(F.min("y_true").alias("y_true"), *[
        F.min(F.when(F.col("arm") == a, F.col("y_pred"))).alias(f"{a.lower()}_pred") for a in arms])


def oof_long(wide: DataFrame) -> DataFrame:
    """Every ``<arm>_pred`` column as rows, the arm in upper case."""
    cols = [c for c in wide.columns if c.endswith("_pred")]
    long = wide.unpivot([*KEY, "y_true"], cols, "arm", "y_pred")
    return long.withColumn("arm", F.upper(F.replace("arm", F.lit("_pred"), F.lit(""))))


def prefix_columns(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def fill_keys(df: DataFrame, keys: DataFrame, on: list[str], value: float = 0.0) -> DataFrame:
    """One row per listed key; absent ones get ``value`` in the numeric columns."""
    rest = [c for c in df.columns if c not in on]
    return keys.join(df, on, "left").select(
        *on, *[F.coalesce(F.col(c), F.lit(value)).alias(c) for c in rest])


def pooled_arm(oof: DataFrame, realisations: list[str], name: str) -> DataFrame:
    """Mean prediction over several realisations of one arm."""
    sub = oof.where(F.col("arm").isin(realisations))
    return sub.groupBy(*KEY).agg(F.min("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred")
                                 ).withColumn("arm", F.lit(name))
