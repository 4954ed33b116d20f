"""Checks on prediction frames, all evaluated in Spark.

Every check yields (check, n_bad); :func:`require` raises when one is positive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.columns import finite

KEY = ["sample_id", "repeat", "outer_fold"]


def require_columns(df: DataFrame, names: list[str], label: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{label}: missing columns {missing}")


def _dup(df: DataFrame, keys: list[str], check: str) -> DataFrame:
    n = df.groupBy(*keys).count().where("count > 1")
    return n.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(check).alias("check"), "n_bad")


def arm_checks(arm: DataFrame, label: str) -> DataFrame:
    """Empty or NULL keys, repeated keys, non-finite values of one arm."""
    require_columns(arm, [*KEY, "y_true", "y_pred"], label)
    null_key = F.lit(False)
    for c in (*KEY, "y_true", "y_pred"):
        null_key = null_key | F.col(c).isNull()
    row = arm.agg(
        F.count_if(F.trim(F.col("sample_id").cast("string")) == "").alias("empty_sample_id"),
        F.count_if(null_key).alias("null_value"),
        F.count_if(~(finite("y_true") & finite("y_pred"))).alias("nonfinite_value"))
    flat = row.unpivot([], row.columns, "check", "n_bad")
    out = flat.unionByName(_dup(arm, KEY, "duplicate_key")).unionByName(
        _dup(arm, ["sample_id", "repeat"], "several_predictions_per_repeat"))
    return out.withColumn("check", F.concat(F.lit(f"{label}: "), "check"))


def pair_checks(a: DataFrame, b: DataFrame, sample_map: DataFrame) -> DataFrame:
    """Agreement of two arms, the sample map, and support in every repeat."""
    require_columns(sample_map, ["sample_id", "seed"], "sample map")
    j = a.select(*KEY, F.col("y_true").alias("ya"), F.lit(1).alias("ia")).join(
        b.select(*KEY, F.col("y_true").alias("yb"), F.lit(1).alias("ib")), KEY, "full")
    agree = j.agg(F.count_if(F.col("ia").isNull() | F.col("ib").isNull()).alias("unpaired_key"),
                  F.count_if(F.col("ya") != F.col("yb")).alias("outcome_differs"))
    maps = sample_map.agg(F.count_if(
        F.col("sample_id").isNull() | F.col("seed").isNull()
        | (F.trim(F.col("sample_id").cast("string")) == "")
        | (F.trim(F.col("seed").cast("string")) == "")).alias("map_empty"))
    unmapped = a.join(sample_map, "sample_id", "left_anti").agg(
        F.count(F.lit(1)).alias("map_missing"))
    per_sample = a.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("y_true").alias("lo"), F.max("y_true").alias("hi"))
    n_rep = a.select(F.count_distinct("repeat").alias("n")).first()["n"]
    support = per_sample.agg(
        F.count_if(F.col("n") != F.lit(n_rep)).alias("incomplete_support"),
        F.count_if(F.col("lo") != F.col("hi")).alias("outcome_changes"))
    small = a.groupBy("repeat").count().agg(F.count_if(F.col("count") < 3).alias("repeat_too_small"))
    seeds = a.join(sample_map.dropDuplicates(["sample_id"]), "sample_id").groupBy(
        "repeat", "seed").agg(F.min("outer_fold").alias("lo"), F.max("outer_fold").alias("hi")).agg(
        F.count_if(F.col("lo") != F.col("hi")).alias("seed_in_several_folds"))
    out = _dup(sample_map, ["sample_id"], "map_duplicate")
    for part in (agree, maps, unmapped, support, small, seeds):
        out = out.unionByName(part.unpivot([], part.columns, "check", "n_bad"))
    return out


def require(checks: DataFrame) -> None:
    bad = checks.where("n_bad > 0").orderBy("check").collect()  # one row per check
    if bad:
        raise ValueError("; ".join(f"{r['check']} ({r['n_bad']})" for r in bad))


def prepare_pair(a: DataFrame, b: DataFrame, sample_map: DataFrame) -> DataFrame:
    """Validated pairs (key, y_true, pa, pb, seed)."""
    require(arm_checks(a, "arm A").unionByName(arm_checks(b, "arm B")))
    require(pair_checks(a, b, sample_map))
    return pair(a, b, sample_map)


def pair(a: DataFrame, b: DataFrame, sample_map: DataFrame) -> DataFrame:
    return a.select(*KEY, "y_true", F.col("y_pred").alias("pa")).join(
        b.select(*KEY, F.col("y_pred").alias("pb")), KEY).join(
        sample_map.select("sample_id", "seed"), "sample_id", "left")


def arm(frame: DataFrame, prediction: str = "y_pred", label: str | None = None) -> DataFrame:
    """One arm of a prediction frame: its keys, outcome and the named prediction, of the
    rows that carry ``label`` if one is given."""
    rows = frame if label is None else frame.where(F.col("arm") == label)
    return rows.select(*KEY, "y_true", F.col(prediction).alias("y_pred"))


def wide_arms(frame: DataFrame, a: str = "c8r_pred", b: str = "c4_pred"
              ) -> tuple[DataFrame, DataFrame]:
    """Both arms of a frame with a prediction column each."""
    require_columns(frame, [*KEY, "y_true", a, b], "two-column predictions")
    return arm(frame, a), arm(frame, b)


def label_checks(frame: DataFrame, labels: list[str]) -> DataFrame:
    """Wanted labels without a row, and labels nobody asked for, as (check, n_bad)."""
    seen = frame.groupBy("arm").agg(F.count(F.lit(1)).alias("n")).where("arm is not null")
    wanted = F.col("arm").isin(labels)
    n = seen.agg(F.count_if(wanted).alias("hit"), F.count_if(~wanted).alias("stray"))
    return n.select(F.explode(F.array(
        F.struct(F.lit("arm label without rows").alias("check"), (F.lit(len(set(labels))) - F.col("hit")).alias("n_bad")),
        F.struct(F.lit("unknown arm label").alias("check"), F.col("stray").alias("n_bad")),
        F.struct(F.lit("arm label named twice").alias("check"),
                 F.lit(len(labels) - len(set(labels))).cast("bigint").alias("n_bad")))).alias("c")).select("c.*")


def labelled_arms(frame: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Both arms of a frame whose column ``arm`` names them; any other label is refused."""
    require_columns(frame, [*KEY, "y_true", "y_pred", "arm"], "labelled predictions")
    require(label_checks(frame, [a, b]))
    return arm(frame, label=a), arm(frame, label=b)


def completion_checks(oof: DataFrame, n_folds: int, n_repeats: int) -> DataFrame:
    """Folds present per arm, missing predictions, rows per repeat."""
    return oof.groupBy("arm").agg(
        F.count_distinct("repeat", "outer_fold").alias("n_folds"),
        F.count_if(~finite("y_pred")).alias("n_missing"),
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("sample_id").alias("n_samples"),
    ).withColumn("complete", (F.col("n_folds") == n_folds * n_repeats) & (F.col("n_missing") == 0)
                 & (F.col("n_rows") == F.col("n_samples") * n_repeats))


def equality_audit(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Key-merge of two versions of a table: rows on one side only, and per column the
    rows that differ (NULLs compare as equal)."""
    l = a.select(*keys, F.lit(1).alias("__a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    r = b.select(*keys, F.lit(1).alias("__b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    j = l.join(r, keys, "full")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return j.agg(
        F.count_if(both).alias("n_both"), F.count_if(F.col("__b").isNull()).alias("n_left_only"),
        F.count_if(F.col("__a").isNull()).alias("n_right_only"),
        *[F.count_if(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"n_diff_{c}")
          for c in cols])
