"""Which communication mode explains a subpath: prefixes, contributions, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.columns import finite
from pathloom.session import broadcast_if_small, side_table

FEATURES = ("nav", "rout", "search", "comm")
ROUTING = ("nav", "rout")  # fixed values: the other two are diffusion
LENGTH_GROUPS = {"short": (1, 3), "medium": (4, 6), "long": (7, 20)}


def prefix_subpaths(paths: DataFrame, edges: DataFrame, target: str = "y") -> DataFrame:
    """Every prefix of every path with the direct (seed, node) features and target.

    A narrow explode and a broadcast join; rows without a finite target or
    feature are dropped.
    """
    pre = paths.select("sample_id", "path_key", F.col("L").alias("path_len"),
                       F.element_at("nodes", 1).alias("u"),
                       F.posexplode(F.slice("nodes", 2, F.size("nodes"))).alias("i", "v"))
    pair = broadcast_if_small(edges.select("u", "v", target, *FEATURES))
    j = pre.join(pair, ["u", "v"]).withColumn("length", F.col("i") + 1).drop("i")
    ok = finite(target)
    for f in FEATURES:
        ok = ok & finite(f)
    return j.where(ok)


def length_scaling(sub: DataFrame) -> DataFrame:
    """Mean and population spread of every feature per prefix length."""
    return sub.groupBy("length").agg(
        *[F.avg(f).alias(f"m_{f}") for f in FEATURES],
        *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES])


def contributions(sub: DataFrame, scaling: DataFrame, coefs: DataFrame) -> DataFrame:
    """|coef * z| per feature, the dominant feature (first wins) and its mode.

    ``coefs`` has (length, coef_source, c_<feature>); both side tables hold one
    row per length.
    """
    j = sub.join(side_table(scaling), "length").join(side_table(coefs), "length")
    c = {f: F.round(F.abs(F.try_divide(F.col(f"c_{f}") * (F.col(f) - F.col(f"m_{f}")), F.col(f"s_{f}"))), 9)
         for f in FEATURES}
    j = j.select("sample_id", "path_key", "path_len", "u", "v", "length", "coef_source",
                 *[F.coalesce(e, F.lit(0.0)).alias(f"contrib_{f}") for f, e in c.items()])
    top = F.array_max(F.array(*[F.struct(F.col(f"contrib_{f}").alias("c"), F.lit(-i).alias("o"),
                                         F.lit(f).alias("f")) for i, f in enumerate(FEATURES)]))
    return j.withColumn("top", top).withColumn(
        "dominant_feature", F.when(F.col("top.c") == 0, "all_zero").otherwise(F.col("top.f"))
    ).withColumn("dominant_type", mode_of(F.col("dominant_feature"))).drop("top")


def mode_of(feature: Column) -> Column:
    return (F.when(feature == "all_zero", "all_zero").when(feature.isin(*ROUTING), "routing")
            .otherwise("diffusion"))


def mode_by_length(contrib: DataFrame) -> DataFrame:
    """Counts and ratios of modes and features, and the share of contribution, per length."""
    valid = F.col("dominant_type") != "all_zero"
    n = F.count_if(valid)
    total = sum((F.sum(F.when(valid, F.col(f"contrib_{f}"))) for f in FEATURES), F.lit(0.0))
    routing = sum((F.sum(F.when(valid, F.col(f"contrib_{f}"))) for f in ROUTING), F.lit(0.0))
    return contrib.groupBy("length", "coef_source").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_distinct("u", "v").alias("n_unique_pairs"),
        F.count_if(~valid).alias("n_all_zero"),
        F.try_divide(F.count_if(F.col("dominant_type") == "routing"), n).alias("routing_ratio"),
        F.try_divide(F.count_if(F.col("dominant_type") == "diffusion"), n).alias("diffusion_ratio"),
        *[F.try_divide(F.count_if(F.col("dominant_feature") == f), n).alias(f"{f}_ratio") for f in FEATURES],
        F.try_divide(routing, total).alias("routing_share"))


def path_classes(contrib: DataFrame) -> DataFrame:
    """Per path: scored prefixes, diffusion prefixes, partial-diffusion flag, coverage."""
    s = contrib.where("dominant_type <> 'all_zero'")
    return s.groupBy("coef_source", "sample_id", "path_key", "path_len").agg(
        F.count(F.lit(1)).alias("n_scored"),
        F.count_if(F.col("dominant_type") == "diffusion").alias("n_diffusion"),
        F.max("length").alias("max_scored")).select(
        "*", (F.col("n_diffusion") > 0).alias("partial"),
        (F.col("max_scored") == F.col("path_len")).alias("complete"))


def transition_by_length(classes: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    part = F.avg(F.col("partial").cast("int"))
    return classes.groupBy("coef_source", F.col("path_len").alias("full_length")).agg(
        n.alias("n_paths"), F.count_distinct("sample_id").alias("n_cells"),
        F.bool_and("complete").alias("coverage_complete"),
        F.count_if("partial").alias("n_partial"), part.alias("partial_ratio"),
        (1.0 - part).alias("persistent_ratio"))


def accumulation(by_length: DataFrame, transition: DataFrame, skip: int = 1) -> DataFrame:
    """1 - prod(1 - p_k) over the ratios of prefix lengths against the observed share.

    For a path of length L the product takes the L table rows after the first
    ``skip`` ones (the published check starts at the second row); NULL when the
    table is too short.
    """
    arr = by_length.groupBy("coef_source").agg(F.array_sort(F.collect_list(
        F.struct("length", "diffusion_ratio"))).alias("r"))  # one entry per length
    j = transition.join(arr, "coef_source")
    used = F.slice(F.col("r"), skip + 1, F.col("full_length"))
    prod = F.aggregate(used, F.lit(1.0), lambda a, s: a * (1.0 - s["diffusion_ratio"]))
    pred = F.when(F.size(used) >= F.col("full_length"), 1.0 - prod)
    return j.select("coef_source", "full_length", pred.alias("predicted"),
                    F.col("partial_ratio").alias("observed"),
                    F.abs(F.col("partial_ratio") - pred).alias("deviation"))


def participation(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Visits of every node after the seed, and its share of the seed's visits."""
    v = paths.select(*keys, F.element_at("nodes", 1).alias("seed"),
                     F.explode(F.slice("nodes", 2, F.size("nodes"))).alias("through"))
    n = v.groupBy(*keys, "seed", "through").agg(F.count(F.lit(1)).alias("visits"))
    total = n.groupBy(*keys, "seed").agg(F.sum("visits").alias("t"))
    return n.join(total, [*keys, "seed"]).select(
        *keys, "seed", "through", "visits", (F.col("visits") / F.col("t")).alias("share"))


def length_group(L: Column) -> Column:
    out = None
    for name, (lo, hi) in LENGTH_GROUPS.items():
        hit = L.between(lo, hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def ordered_axis(nodes: DataFrame, order: list, network: str, name: str) -> DataFrame:
    """Axis position: network in the stated order (unknown last), then name."""
    from pathloom.operators.ordered import row_position

    at = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(network))
    k = F.when(F.coalesce(at, F.lit(0)) == 0, len(order) + 1).otherwise(at)
    return row_position(nodes.withColumn("__k", k), [], ["__k", name], "axis").drop("__k")


def compare_cohorts(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """Values of two cohorts side by side, NULL where one has none."""
    return a.select(*on, F.col(value).alias(f"{value}_a")).join(
        b.select(*on, F.col(value).alias(f"{value}_b")), on, "full").withColumn(
        "difference", F.col(f"{value}_a") - F.col(f"{value}_b"))
