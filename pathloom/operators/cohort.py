"""Comparing and matching two cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.columns import hash_hex
from pathloom.operators.ordered import row_position


def smd_columns(df: DataFrame, cohort: str, a: str, b: str, variables: dict[str, Column]
                ) -> DataFrame:
    """(variable, smd): standardised mean difference of cohort a minus b, 0 if both are constant.

    One pass: two moments per variable and cohort.
    """
    side = lambda s, c: F.when(F.col(cohort) == s, c.cast("double"))
    stats = []
    for name, c in variables.items():
        va, vb = F.var_samp(side(a, c)), F.var_samp(side(b, c))
        smd = F.when(va + vb > 0, (F.avg(side(a, c)) - F.avg(side(b, c))) / F.sqrt((va + vb) / 2.0)
                     ).otherwise(0.0)
        stats.append(F.struct(F.lit(name).alias("variable"), smd.alias("smd")))
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def max_abs_smd(smd: DataFrame, block: Column) -> DataFrame:
    return smd.groupBy(block.alias("block")).agg(F.max(F.abs("smd")).alias("max_abs_smd"))


def stratum_sizes(df: DataFrame, cohort: str, a: str, b: str, strata: list[str]) -> DataFrame:
    """Common strata with both counts and the matched size."""
    n = df.groupBy(*strata).agg(F.count_if(F.col(cohort) == a).alias("n_a"),
                                F.count_if(F.col(cohort) == b).alias("n_b"))
    return n.where("n_a > 0 and n_b > 0").withColumn("n_matched", F.least("n_a", "n_b"))


def stratified_match(df: DataFrame, cohort: str, a: str, b: str, strata: list[str], key: str,
                     tag: str) -> DataFrame:
    """From every common stratum the same number of rows of either cohort, in hash order."""
    sizes = stratum_sizes(df, cohort, a, b, strata)
    placed = row_position(
        df.where(F.col(cohort).isin(a, b)).withColumn("__h", hash_hex(tag, F.col(key))),
        [*strata, cohort], ["__h", key], "__pos")
    return placed.join(sizes.select(*strata, "n_matched"), strata).where(
        "__pos <= n_matched").drop("__pos", "__h", "n_matched")


def pair_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct key pairs of either cohort and in common; repeats collapse map-side."""
    both = a.select(*keys, F.lit(1).alias("ia"), F.lit(0).alias("ib")).unionByName(
        b.select(*keys, F.lit(0).alias("ia"), F.lit(1).alias("ib")))
    per = both.groupBy(*keys).agg(F.max("ia").alias("ia"), F.max("ib").alias("ib"))
    return per.agg(F.sum("ia").alias("n_a"), F.sum("ib").alias("n_b"),
                   F.sum(F.col("ia") * F.col("ib")).alias("n_common"))


def summary(sections: dict[str, DataFrame], name: str, value: str) -> DataFrame:
    """Section tables under one schema (section, name, value)."""
    out = None
    for label, df in sections.items():
        part = df.select(F.lit(label).alias("section"), F.col(name).cast("string").alias("name"),
                         F.col(value).cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def importance_shares(df: DataFrame, feature: str, value: str) -> DataFrame:
    """Absolute importances as percent of their total, and the feature's prefix group."""
    total = df.agg(F.sum(F.abs(value)).alias("s")).first()["s"]
    return df.withColumn("share", 100.0 * F.abs(value) / F.lit(total)).withColumn(
        "grp", F.regexp_extract(feature, "^([A-Za-z]+)_", 1))
