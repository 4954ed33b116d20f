"""Fold manifests: grouped, stratified and leave-one-source-out splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from pathloom.functions.columns import hash_hex
from pathloom.operators.ordered import row_position

DISTINCT_SIZE_LIMIT = 2_000_000  # distinct group sizes; N rows have at most sqrt(2 N)


def fill_schedule(sizes: list[tuple[int, int]], n_folds: int) -> list[tuple]:
    """Largest-first filling of the lightest fold, as runs of repeating fold cycles.

    ``sizes`` are (size, how many groups).  Groups of one size are
    interchangeable, so a run (size, start, length, cycle) says: the groups at
    positions start.. of that size take the folds of ``cycle`` in turn.  Whole
    cycles are skipped at once, hence the work depends on the number of distinct
    sizes only.  Ties go to the lowest fold number.
    """
    load = [0] * n_folds
    runs = []
    for size, count in sorted(sizes, reverse=True):
        at = 0
        while at < count:
            order = sorted(range(n_folds), key=lambda f: (load[f], f))
            near = [f for f in order if load[f] < load[order[0]] + size]
            far = order[len(near):]
            if far:
                # cycles all of whose picks stay below the next fold's load
                turns = (load[far[0]] - load[near[-1]] - 1) // size if size else 0
            else:
                turns = (count - at) // len(near)
            turns = min(turns, (count - at) // len(near))
            if turns > 0:
                n = turns * len(near)
                for f in near:
                    load[f] += turns * size
                runs.append((size, at, n, near))
            else:
                n = 1
                load[order[0]] += size
                runs.append((size, at, n, [order[0]]))
            at += n
    return runs


def grouped_folds(groups: DataFrame, group: str, repeats: int, n_folds: int = 5,
                  tag: str = "fold") -> DataFrame:
    """(repeat, group, test_fold): whole groups to folds, largest first to the lightest.

    ``groups`` has one row per group with its ``size``.  Every repeat orders
    groups of equal size by another hash.
    """
    spark = groups.sparkSession
    hist = groups.groupBy("size").agg(F.count(F.lit(1)).alias("n")).limit(DISTINCT_SIZE_LIMIT + 1)
    sizes = [(r["size"], r["n"]) for r in hist.collect()]  # one row per distinct size
    if len(sizes) > DISTINCT_SIZE_LIMIT:
        raise ValueError("more distinct group sizes than the schedule is meant for")
    schema = StructType([StructField("size", LongType()), StructField("start", LongType()),
                         StructField("n", LongType()),
                         StructField("cycle", ArrayType(IntegerType()))])
    runs = spark.createDataFrame(fill_schedule(sizes, n_folds), schema)
    each = groups.select(group, F.col("size").cast("bigint").alias("size"),
                         F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    each = each.withColumn("h", hash_hex(tag, F.col("repeat"), F.col(group)))
    placed = row_position(each, ["repeat", "size"], ["h", group])
    j = placed.withColumn("j", F.col("pos") - 1).join(runs, "size").where(
        "j >= start and j < start + n")
    return j.select("repeat", group, F.element_at(
        "cycle", (F.pmod(F.col("j") - F.col("start"), F.size("cycle").cast("bigint")) + 1)
        .cast("int")).alias("test_fold"))


def stratified_folds(df: DataFrame, label: str, key: str, n_folds: int = 5, repeats: int = 1,
                     tag: str = "strat") -> DataFrame:
    """(repeat, key, label, fold): every class dealt out in hash order."""
    each = df.select(key, label, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    each = each.withColumn("h", hash_hex(tag, F.col("repeat"), F.col(key)))
    placed = row_position(each, ["repeat", label], ["h", key])
    return placed.select("repeat", key, label, F.pmod(F.col("pos") - 1, F.lit(n_folds).cast("bigint"))
                         .cast("int").alias("fold"))


def source_split(df: DataFrame, source: str, key: str, train_share: dict, tag: str) -> DataFrame:
    """Role per row: the first share of every source in hash order trains, the rest tests.

    ``train_share`` maps source to the share; 1.0 means the whole source trains.
    """
    n = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    placed = row_position(df.select(key, source).withColumn("h", hash_hex(tag, F.col(key))),
                          [source], ["h", key])
    share = F.lit(None).cast("double")
    for s, v in train_share.items():
        share = F.when(F.col(source) == s, F.lit(float(v))).otherwise(share)
    j = placed.join(n, source).where(share.isNotNull())
    cut = F.round(share * F.col("n") - 1e-9).cast("bigint")
    return j.select(key, source, F.when(F.col("pos") <= cut, "train").otherwise("test").alias("role"))


def group_of(folds: DataFrame, repeat: int, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows of one outer fold."""
    r = folds.where(F.col("repeat") == repeat)
    return r.where(F.col("test_fold") != fold), r.where(F.col("test_fold") == fold)
