"""Order-dependent operators that hold for groups of any size.

A plain window sorts one group in one task.  That is used for checked small
inputs only; beyond, rows are range-partitioned on
(keys, order, tiebreak), so a hot group spreads over many tasks; every partition
scans its own part and takes a carry from the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.session import broadcast_if_small, is_small, materialize

SMALL = 50_000  # rows (or rows per group) that one task may sort or hold

_OPS = {"sum": F.sum, "min": F.min, "max": F.max}
_MERGE = {
    "sum": lambda a, b: a + b,
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}


def _sort_columns(order) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c) for c in order]


def scan(df: DataFrame, keys: list[str], order: list, running: dict[str, tuple[str, Column]]
         ) -> DataFrame:
    """Inclusive running aggregates per ``keys`` in ``order``.

    ``running`` maps output name to (``sum``/``min``/``max``, expression).
    ``order`` must be total within a group (add an id as tiebreak).  A NULL key is
    a group like any other.
    """
    order_cols = _sort_columns(order)
    if is_small(df, SMALL):
        w = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order_cols)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.select("*", *[_OPS[op](expr).over(w).alias(n)
                                for n, (op, expr) in running.items()])
    for name, (_, expr) in running.items():
        df = df.withColumn(f"__x_{name}", expr)
    placed = materialize(
        df.repartitionByRange(*[F.col(k) for k in keys], *order_cols)
        .withColumn("__pid", F.spark_partition_id()))
    part = ["__pid", *keys]
    totals = placed.groupBy(*part).agg(
        *[_OPS[op](f"__x_{n}").alias(f"__t_{n}") for n, (op, _) in running.items()])
    # one row per (group, partition it touches): at most groups + partitions rows
    before = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__pid")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(
        *part, *[_OPS[op](f"__t_{n}").over(before).alias(f"__c_{n}")
                 for n, (op, _) in running.items()])
    here = (Window.partitionBy(*part).orderBy(*order_cols)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = placed
    for n, (op, _) in running.items():
        local = local.withColumn(f"__l_{n}", _OPS[op](f"__x_{n}").over(here))
    same = F.col("__pid") == F.col("__k___pid")
    for k in keys:  # null-safe
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    carry = carry.select(*[F.col(c).alias(f"__k_{c}") for c in part], *[f"__c_{n}" for n in running])
    out = local.join(broadcast_if_small(materialize(carry)), same, "left")
    for n, (op, _) in running.items():
        out = out.withColumn(n, F.when(F.col(f"__c_{n}").isNull(), F.col(f"__l_{n}"))
                             .otherwise(_MERGE[op](F.col(f"__c_{n}"), F.col(f"__l_{n}"))))
    drop = ["__pid", *[f"__k_{c}" for c in part]]
    for n in running:
        drop += [f"__x_{n}", f"__l_{n}", f"__c_{n}"]
    return out.drop(*drop)


def row_position(df: DataFrame, keys: list[str], order: list, name: str = "pos") -> DataFrame:
    """1-based position of every row within its group."""
    return scan(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))})


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per (keys, value) with ``n_at``, ``n_before`` and the average rank.

    Equal values collapse in the partial aggregation, so a hot value costs nothing.
    """
    counted = materialize(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_at")))
    run = scan(counted, keys, [value], {"__upto": ("sum", F.col("n_at"))})
    return run.select(
        *keys, value, "n_at", (F.col("__upto") - F.col("n_at")).alias("n_before"),
        (F.col("__upto") - F.col("n_at") + (F.col("n_at") + 1) / 2.0).alias("avg_rank"))


BRACKET = 10_000  # accuracy of the sketch that brackets a quantile


def _interpolation(qs: dict[str, float], n: Column):
    """(name, lower index, upper index, weight) of linear interpolation."""
    for name, q in qs.items():
        at = (n - 1) * F.lit(float(q))
        yield name, F.floor(at), F.ceil(at), at - F.floor(at)


def _pick(runs: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Quantiles from rows (value, n_before, n_at, __n)."""
    holds = lambda i: (F.col("n_before") <= i) & (i < F.col("n_before") + F.col("n_at"))
    aggs = []
    for name, lo, hi, w in _interpolation(qs, F.col("__n")):
        aggs += [F.max(F.when(holds(lo), F.col(value))).alias(f"__lo_{name}"),
                 F.max(F.when(holds(hi), F.col(value))).alias(f"__hi_{name}"),
                 F.max(w).alias(f"__w_{name}")]
    lo, hi, w = (lambda n: F.col(f"__lo_{n}")), (lambda n: F.col(f"__hi_{n}")), (
        lambda n: F.col(f"__w_{n}"))
    return runs.groupBy(*keys).agg(*aggs).select(
        *keys, *[(lo(n) + w(n) * (hi(n) - lo(n))).alias(n) for n in qs])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]
                    ) -> DataFrame:
    """Exact quantiles with linear interpolation, for groups of any size.

    Groups of up to ``SMALL`` rows take the plain percentile.  Beyond: a mergeable sketch per group brackets every quantile; only the
    sketches are shuffled.  Second pass: rows below the brackets are counted,
    rows inside are kept as (value, count) - a small share of a big group - and
    ranked by the distributed scan.  A bracket that misses its rank sends the
    group to the full ranking, so the result is exact in any case.
    """
    if not keys:
        one = exact_quantiles(df.select(value).withColumn("__all", F.lit(0)), ["__all"], value, qs)
        return one.drop("__all")
    df = df.select(*keys, value).where(F.col(value).isNotNull())
    eps = 2.0 / BRACKET
    probs = [min(max(q + d, 0.0), 1.0) for q in qs.values() for d in (-eps, eps)]
    sk = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.percentile_approx(value, probs, BRACKET).alias("__b"))
    # groups no larger than the sketch are kept whole: interpolation needs neighbours
    sk = materialize(sk)
    if (sk.agg(F.max("__n").alias("m")).first()["m"] or 0) <= SMALL:
        return df.groupBy(*keys).agg(*[F.percentile(value, float(q)).alias(n) for n, q in qs.items()])
    sk = broadcast_if_small(sk)
    inside = F.lit(False)
    for i in range(len(qs)):
        inside = inside | F.col(value).between(F.col("__b")[2 * i], F.col("__b")[2 * i + 1])
    small = F.col("__n") <= BRACKET
    j = df.join(sk, keys).withColumn("__in", inside | small)
    # runs of values between brackets are replaced by their count at the next kept value
    gaps = [F.count_if(~F.col("__in") & (F.col(value) < F.col("__b")[2 * i])).alias(f"__g{i}")
            for i in range(len(qs))]
    below = j.groupBy(*keys).agg(*gaps)
    kept = j.where("__in").groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n_at"), F.first("__n").alias("__n"), F.first("__b").alias("__b"))
    run = scan(kept, keys, [value], {"__upto": ("sum", F.col("n_at"))})
    run = run.join(broadcast_if_small(materialize(below)), keys)
    # values left out below the highest bracket that starts at or below this value
    skipped = F.lit(0).cast("bigint")
    for i in range(len(qs)):
        skipped = F.greatest(skipped, F.when(
            F.col(value) >= F.col("__b")[2 * i], F.col(f"__g{i}")).otherwise(0))
    ranked = run.withColumn("n_before", F.col("__upto") - F.col("n_at") + F.when(
        F.col("__n") <= BRACKET, 0).otherwise(skipped))
    out = materialize(_pick(ranked, keys, value, qs))
    miss = F.lit(False)
    for n in qs:
        miss = miss | F.col(n).isNull()
    bad = out.where(miss).select(*keys)
    if bad.isEmpty():
        return out
    again = df.join(bad, keys, "left_semi")
    full = value_ranks(again, keys, value).join(sk.select(*keys, "__n"), keys)
    return out.where(~miss).unionByName(_pick(full, keys, value, qs))
