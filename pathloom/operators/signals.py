"""Threshold events in signals and their roll-up to response matrices.

Signals are long: one row per (keys, t, value).  Every step is an aggregation
with map-side combine, so one channel may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.ordered import exact_quantiles

BASELINE_MS = (-300.0, -50.0)  # fixed values of the recording protocol
RESPONSE_MS = (0.0, 100.0)
THRESHOLD = 5.0


def baseline_stats(signal: DataFrame, keys: list[str], window=BASELINE_MS) -> DataFrame:
    inside = F.col("t").between(*window)
    x = F.when(inside, F.col("value"))
    return signal.groupBy(*keys).agg(F.avg(x).alias("base_mean"), F.stddev_pop(x).alias("base_std"))


def baseline_zscore(signal: DataFrame, keys: list[str], window=BASELINE_MS) -> DataFrame:
    """``z`` against the baseline of the same group; 0 where the baseline is flat."""
    s = baseline_stats(signal, keys, window)
    z = F.when(F.col("base_std") > 0, (F.col("value") - F.col("base_mean")) / F.col("base_std"))
    return signal.join(s, keys).withColumn("z", F.coalesce(z, F.lit(0.0))).drop(
        "base_mean", "base_std")


def detect_events(signal: DataFrame, keys: list[str], baseline=BASELINE_MS, response=RESPONSE_MS,
                  threshold: float = THRESHOLD) -> DataFrame:
    """Onset and peak per group.

    Onset: first response sample with |z| strictly above the threshold.  Peak:
    first largest |z| from the onset on.  No earlier sample exceeds the
    threshold, so this is the largest of the whole response window and both come
    from one aggregation.
    """
    z = baseline_zscore(signal, keys, baseline)
    inside = F.col("t").between(*response)
    a = F.abs(F.col("z"))
    agg = z.groupBy(*keys).agg(
        F.min(F.when(inside & (a > threshold), F.col("t"))).alias("onset"),
        F.max(F.when(inside, F.struct(a.alias("a"), (-F.col("t")).alias("nt"),
                                      F.col("z").alias("z")))).alias("p"))
    hit = F.col("onset").isNotNull()
    return agg.select(
        *keys, "onset", F.when(hit, -F.col("p.nt")).alias("peak"),
        F.when(hit, F.col("p.z")).alias("peak_amplitude"), hit.alias("significant"))


def response_matrix(events: DataFrame, stim: str, observed: str) -> DataFrame:
    """Response probability and median onset per (stimulated, observed) pair."""
    n = events.groupBy(stim, observed).agg(
        F.count(F.lit(1)).alias("n_trials"), F.count_if("significant").alias("n_onset"))
    med = exact_quantiles(events.where("significant"), [stim, observed], "onset",
                          {"median_onset": 0.5})
    return n.join(med, [stim, observed], "left").withColumn(
        "probability", F.col("n_onset") / F.col("n_trials"))


def stimulated_electrode(electrodes: DataFrame, requests: DataFrame) -> DataFrame:
    """The subject's electrode of the requested run, else of its first row."""
    j = requests.join(electrodes, "subject")
    best = j.groupBy("subject", "want_run").agg(F.min(F.struct(
        (F.col("run_number") != F.col("want_run")).alias("other"), "ord", "electrode")).alias("b"))
    return best.select("subject", "want_run", F.col("b.electrode").alias("electrode"),
                       (~F.col("b.other")).alias("exact_run"))


def with_fallback(wanted: DataFrame, source: DataFrame, key: str, run: str, value: str
                  ) -> DataFrame:
    """Value of the own run, else of run 1, else the row is skipped."""
    own = source.select(key, run, F.col(value).alias("__own"))
    first = source.where(F.col(run) == 1).select(key, F.col(value).alias("__first"))
    return (wanted.join(own, [key, run], "left").join(first, key, "left")
            .withColumn(value, F.coalesce("__own", "__first")).where(F.col(value).isNotNull())
            .drop("__own", "__first"))


def parcel_signal(samples: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Mean signal of the electrodes of every parcel, good channels only."""
    good = samples.where(F.lower("status") == "good") if "status" in samples.columns else samples
    return good.join(mapping.select("electrode", "parcel"), "electrode").groupBy(
        "parcel", *keys).agg(F.avg("value").alias("value"),
                             F.countDistinct("electrode").alias("n_electrodes"))
