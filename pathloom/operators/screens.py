"""Screens: predicates over paths that answer with a reject reason or NULL.

A path row carries ``nodes``, ``lat`` (latency at each node, seed first) and one
array per edge attribute (``w``, ``tract``, ``nav``, ``rout``, ``search``,
``comm``; NULL where the edge is absent).  Every screen is one column
expression, so screening never shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.columns import arr_mean, arr_median, arr_var_pop, finite, steps
from pathloom.operators.ordered import exact_quantiles

METRICS = ("nav", "rout", "search", "comm")
COMPLEXITY_THRESHOLD = 0.41549280879846406  # fixed value: pool median of the main screen
VELOCITY_BOUNDS = (1.0, 150.0)  # fixed values
SUPPORT_MIN_SINGLE, SUPPORT_MIN_LONGER = 1, 5  # fixed values: accepted paths per cell


@dataclass(frozen=True)
class ScreenParams:
    half: int = 180
    transition_max: int = 3
    oscillation_check: bool = True
    velocity_lower: float = VELOCITY_BOUNDS[0]
    velocity_upper: float = VELOCITY_BOUNDS[1]
    bin_widths: tuple[float, ...] = (1.0, 2.0, 5.0)
    min_legal_bins: int = 2
    mean_weight_min: float = 0.0
    ratio_lower: float = 0.0
    ratio_upper: float = float("inf")
    complexity_min: float = COMPLEXITY_THRESHOLD
    keep: int = 128  # paths kept after diversity selection
    jaccard: float = 0.80
    extra: dict = field(default_factory=dict)


def _pairs_any(a: Column, test) -> Column:
    """True when ``test(left, right)`` holds for some neighbours of the array."""
    n = F.size(a)
    return F.exists(F.zip_with(F.slice(a, 1, n - 1), F.slice(a, 2, n - 1), test), lambda b: b)


def transitions(labels: Column) -> Column:
    n = F.size(labels)
    return F.size(F.filter(
        F.zip_with(F.slice(labels, 1, n - 1), F.slice(labels, 2, n - 1), lambda x, y: x != y),
        lambda b: b))


def oscillates(labels: Column, relay: Column) -> Column:
    """A-B-A among labels whose middle node is no relay."""
    idx = F.when(F.size(labels) >= 3, F.sequence(F.lit(1), F.size(labels) - 2)).otherwise(
        F.array().cast("array<int>"))
    return F.exists(idx, lambda i: (F.element_at(labels, i) == F.element_at(labels, i + 2))
                    & (F.element_at(labels, i) != F.element_at(labels, i + 1))
                    & ~F.element_at(relay, i + 1))


def anatomical(p: ScreenParams) -> Column:
    """Needs arrays ``network``, ``lobe`` and ``relay`` along the nodes."""
    nodes = F.col("nodes")
    side = F.element_at(nodes, 1) < p.half
    r = F.when(F.exists(nodes, lambda x: (x < p.half) != side), "CROSS_HEMISPHERE").when(
        transitions(F.col("network")) > p.transition_max, "TOO_MANY_NETWORK_TRANSITIONS")
    if p.oscillation_check:
        r = r.when(oscillates(F.col("lobe"), F.col("relay")), "LOBE_OSCILLATION")
    return r


def velocity(p: ScreenParams) -> Column:
    d = steps("lat")
    v = F.zip_with("tract", d, lambda t, s: t / s)
    return F.when(F.exists(d, lambda x: x <= 0), "NONPOSITIVE_LATENCY_DIFF").when(
        F.exists(v, lambda x: (x < p.velocity_lower) | (x > p.velocity_upper)),
        "VELOCITY_OUT_OF_RANGE")


def _floor_bins(width: float) -> Column:
    return F.transform("lat", lambda x: F.floor(x / width))


def temporal(p: ScreenParams) -> Column:
    legal = F.lit(0)
    for width in p.bin_widths:
        bins = _floor_bins(width)
        legal = legal + F.when(F.forall(steps(bins), lambda d: d > 0), 1).otherwise(0)
    return F.when(F.exists(steps("lat"), lambda x: x <= 0), "RAW_NONSTRICT").when(
        legal < p.min_legal_bins, "INSUFFICIENT_BIN_CONSISTENCY")


def strength(p: ScreenParams) -> Column:
    return F.when(arr_mean("w") < F.lit(p.mean_weight_min), "SC_BELOW_40TH_PERCENTILE")


def validity(p: ScreenParams | None = None) -> Column:
    """Hard validity; the reason is the first failure in scan order.

    Needs ``edge_ok`` (boolean per edge) next to the metric arrays.
    """
    n = F.size("nodes")
    at = lambda c, i: F.element_at(F.col(c), i)
    checks = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.when(~F.coalesce(at("edge_ok", i), F.lit(False)), "SC_EDGE_ABSENT")
        .when(F.coalesce(at("lat", i + 1) <= at("lat", i), F.lit(True)), "NONSTRICT_TEMPORAL")
        .when(~(finite(at("nav", i)) & finite(at("rout", i)) & finite(at("search", i))
                & finite(at("comm", i))), "METRIC_NONFINITE"))
    return F.when(F.size(F.array_distinct("nodes")) != n, "REPEATED_ROI").otherwise(
        F.try_element_at(F.filter(checks, lambda r: r.isNotNull()), F.lit(1)))


def coherence(p: ScreenParams) -> Column:
    bad = F.lit(False)
    for m in METRICS:
        bad = bad | F.exists(F.col(m), lambda x: ~F.coalesce(finite(x) & (x >= 0), F.lit(False)))
    ratio = arr_mean("nav") / F.nullif(arr_mean("rout"), F.lit(0.0))
    outside = (ratio < F.lit(p.ratio_lower)) | (ratio > F.lit(p.ratio_upper)) | ratio.isNull()
    return F.when(bad, "METRIC_NONFINITE").when(outside, "NAV_ROUT_RATIO_EXTREME")


def complexity_stat() -> Column:
    """Sum over the four metrics of a quarter of the variance along the path."""
    return sum((arr_var_pop(m) / 4.0 for m in METRICS), F.lit(0.0))


def complexity(p: ScreenParams) -> Column:
    stat = F.round(complexity_stat(), 9)
    return F.when((F.size("nodes") > 2) & (stat < F.lit(p.complexity_min)),
                  "VARIANCE_BELOW_MEDIAN")


def median_velocity(p: ScreenParams) -> Column:
    pairs = F.filter(F.zip_with("tract", steps("lat"), lambda t, s: F.struct(
        t.alias("t"), (t / s).alias("v"))), lambda e: e["t"] > 0)
    v = F.transform(pairs, lambda e: e["v"])
    med = arr_median(v)
    return F.when((F.size(v) > 0) & ((med < p.velocity_lower) | (med > p.velocity_upper)),
                  "MEDIAN_VELOCITY_OUT_OF_RANGE")


# name -> screens applied in order; the first reason wins.  Users add entries.
SCREENS: dict[str, list[Callable[[ScreenParams], Column]]] = {
    "B1": [anatomical], "B2": [velocity], "B3": [temporal], "B4": [strength],
    "B5": [validity], "B6": [coherence],
    "S10": [validity, complexity], "S14": [validity, median_velocity],
}


def apply_screen(paths: DataFrame, name: str, p: ScreenParams) -> DataFrame:
    """Add ``reject_reason`` (NULL = accepted)."""
    forbid_target(paths)
    return paths.withColumn("reject_reason", F.coalesce(*[f(p) for f in SCREENS[name]]))


def forbid_target(df: DataFrame, names: tuple[str, ...] = ("y", "y_true", "y_endpoint")) -> None:
    """Screens must not see the outcome."""
    seen = [c for c in df.columns if c in names]
    if seen:
        raise ValueError(f"outcome columns reach the screen: {seen}")


def node_attributes(paths: DataFrame, nodes: DataFrame, attrs: list[str], keys: list[str]
                    ) -> DataFrame:
    """Arrays of node attributes along every path (a group is one path)."""
    from pathloom.session import broadcast_if_small

    rows = paths.select(*keys, F.posexplode("nodes").alias("i", "node")).join(
        broadcast_if_small(nodes.select("node", *attrs)), "node", "left")
    packed = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("i", *attrs))).alias("__n"))
    packed = packed.select(*keys, *[F.col("__n")[a].alias(a) for a in attrs])
    return paths.join(packed, keys)


def weight_cut(paths: DataFrame, q: float = 0.4) -> float:
    """Global quantile of the mean path weight, exact for any number of paths."""
    means = paths.select(arr_mean("w").alias("m"))
    return exact_quantiles(means, [], "m", {"c": q}).first()["c"]


def complexity_cut(paths: DataFrame, q: float = 0.5) -> float:
    """Pool quantile of the complexity statistic over paths of two or more edges."""
    stats = paths.where(F.size("nodes") > 2).select(F.round(complexity_stat(), 9).alias("m"))
    return exact_quantiles(stats, [], "m", {"c": q}).first()["c"]


# ---- attrition and support ----------------------------------------------------


def attrition(screened: DataFrame, cell: list[str]) -> DataFrame:
    """Per cell: candidates, accepted, rejected, reasons with counts, support."""
    by_reason = screened.groupBy(*cell, "reject_reason").agg(F.count(F.lit(1)).alias("n"))
    out = by_reason.groupBy(*cell).agg(
        F.sum("n").alias("n_candidate"),
        F.coalesce(F.sum(F.when(F.col("reject_reason").isNull(), F.col("n"))), F.lit(0))
        .alias("n_accepted"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col("reject_reason").isNotNull(), F.struct("reject_reason", "n")))))
        .alias("reasons"))
    return out.withColumn("n_rejected", F.col("n_candidate") - F.col("n_accepted")).withColumn(
        "reject_reason_breakdown", F.to_json("reasons")).drop("reasons").withColumn(
        "in_support", in_support(F.col("L"), F.col("n_accepted")))


def in_support(L: Column, n_accepted: Column) -> Column:
    return F.when(L == 1, n_accepted >= SUPPORT_MIN_SINGLE).otherwise(
        n_accepted >= SUPPORT_MIN_LONGER)


def support_class(in_sup: Column, n_candidate: Column, n_valid: Column, L: Column) -> Column:
    """Why a cell is (not) supported."""
    return (F.when(in_sup, "passed").when(n_candidate == 0, "no_candidate")
            .when(~in_support(L, n_valid), "insufficient_B5").otherwise("insufficient_variance"))


def relaxed_ladder(pool: DataFrame, cells: DataFrame, rules: dict[str, float | None],
                   need: float = 0.5) -> DataFrame:
    """Support share under successively weaker thresholds; ``chosen`` marks the first
    rule that supports at least ``need`` of the cells.

    ``pool`` has (sample_id, L, stat); a rule of None drops the threshold.  All
    rules are counted in one pass.
    """
    names = list(rules)
    ok = lambda cut: F.lit(True) if cut is None else (F.col("L") < 2) | (
        F.coalesce(F.col("stat") >= F.lit(cut), F.lit(False)))
    per_cell = pool.groupBy("sample_id").agg(
        *[F.count_if(ok(c)).alias(f"n{i}") for i, c in enumerate(rules.values())])
    joined = cells.select("sample_id", "L").join(per_cell, "sample_id", "left")
    row = joined.agg(
        F.count(F.lit(1)).alias("n_cells"),
        *[F.count_if(in_support(F.col("L"), F.coalesce(f"n{i}", F.lit(0)))).alias(f"s{i}")
          for i in range(len(names))])
    out = row.select("n_cells", F.explode(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(n).alias("rule"), F.col(f"s{i}").alias("n_supported"))
        for i, n in enumerate(names)])).alias("r")).select("n_cells", "r.*")
    share = F.col("n_supported") / F.col("n_cells")
    first = row.select(F.coalesce(*[F.when(F.col(f"s{i}") >= need * F.col("n_cells"), F.lit(i))
                                    for i in range(len(names))]).alias("first")).first()["first"]
    return out.select("step", "rule", "n_cells", "n_supported", share.alias("share"),
                      (F.col("step") == F.lit(-1 if first is None else first)).alias("chosen"))
