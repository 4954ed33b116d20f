"""Resampling inference on per-unit sums, and multiplicity corrections.

Draws are rows.  A draw's randomness is a hash of (tag, draw, unit), so results
do not depend on partitioning, order or lost executors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pathloom.functions.columns import hash_mod
from pathloom.functions.java import java_function
from pathloom.operators.metrics import r2_from_sums, sufficient_stats
from pathloom.operators.ordered import exact_quantiles, row_position, scan, value_ranks
from pathloom.session import broadcast_if_small, materialize, side_table

TASK_PICKS = 2_000_000  # picks that a task of a bootstrap makes
JAVA_PICKS = 20_000_000  # the same where the JVM makes them
PACKED = 48_000_000  # bytes of values that a bootstrap sends with its draws; beyond, picks are joined
SLOTS = 100_000  # slots of a class whose picks are held together

BITS = 256  # signs served by one SHA-256


def unit_contributions(paired: DataFrame, unit: str) -> DataFrame:
    """(unit, d): share of every unit in the difference of mean pooled R2.

    Two aggregations: the spread per repeat, then the error difference per
    (repeat, unit) divided by it.
    """
    y = F.col("y_true")
    n = F.count(F.lit(1))
    sst = paired.groupBy("repeat").agg((F.sum(y * y) - F.sum(y) * F.sum(y) / n).alias("sst"))
    sst = side_table(sst)
    n_rep = F.lit(sst.count())
    diff = paired.groupBy("repeat", unit).agg(F.sum(
        (y - F.col("pb")) * (y - F.col("pb")) - (y - F.col("pa")) * (y - F.col("pa"))).alias("e"))
    return diff.join(sst, "repeat").groupBy(unit).agg(
        (F.sum(F.col("e") / F.col("sst")) / n_rep).alias("d"))


def sign_bits(units: DataFrame, unit: str, draws: int, tag: str) -> DataFrame:
    """(unit columns, draw, sign): one hash serves 256 draws of a unit."""
    blocks = (draws + BITS - 1) // BITS
    h = units.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn(
        "h", F.sha2(F.concat_ws("|", F.lit(tag), F.col(unit).cast("string"),
                                F.col("blk").cast("string")), 256))
    bits = h.select(*units.columns, "blk", F.posexplode(F.split("h", "")).alias("p", "hex")).where(
        "hex <> ''")
    digit = F.conv("hex", 16, 10).cast("int")
    four = bits.select(*units.columns, "blk", "p", digit.alias("dg"),
                       F.explode(F.sequence(F.lit(0), F.lit(3))).alias("b"))
    draw = F.col("blk") * BITS + F.col("p") * 4 + F.col("b")
    return four.select(*units.columns, draw.alias("draw"),
                       (1 - 2 * F.getbit("dg", F.col("b"))).alias("sign")).where(
        F.col("draw") < draws)


def signflip(contrib: DataFrame, unit: str, draws: int, tag: str, digits: int = 12) -> DataFrame:
    """Sign-flip test: observed sum, tail counts and both p-value conventions."""
    null = sign_bits(contrib, unit, draws, tag).groupBy("draw").agg(
        F.round(F.sum(F.col("sign") * F.col("d")), digits).alias("null"))
    obs = contrib.agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("n")).first()
    seen = F.lit(obs["s"])
    r = null.agg(F.count_if(F.col("null") <= F.round(seen, digits)).alias("lower_tail"),
                 F.count_if(F.col("null") >= F.round(seen, digits)).alias("upper_tail"))
    tail = F.least("lower_tail", "upper_tail")
    return r.select(
        F.lit(obs["n"]).alias("n_units"), seen.alias("observed"), "lower_tail", "upper_tail",
        F.least(F.lit(1.0), 2.0 * tail / draws).alias("p_two_sided"),
        F.least(F.lit(1.0), 2.0 * (tail + 1) / (draws + 1)).alias("p_two_sided_plus1"))


def within_repeat_contributions(paired: DataFrame, cluster: str) -> DataFrame:
    """Exchange units of the older test: (cluster, repeat) pairs."""
    p = paired.withColumn("unit", F.concat_ws("|", F.col(cluster), F.col("repeat")))
    return unit_contributions(p, "unit")


# ---- cluster bootstrap ----------------------------------------------------------


def cluster_bootstrap(oof: DataFrame, cluster: str, draws: int, tag: str) -> DataFrame:
    """(draw, arm, r2): mean pooled R2 of every resample of whole clusters.

    Clusters are numbered once; slot i of draw b picks cluster hash(b, i) mod n.
    All arms share the picks, so differences are paired.  A draw costs one row
    per cluster: rows were reduced to sums per (cluster, arm, repeat) before.
    """
    stats = materialize(sufficient_stats(oof, [cluster, "arm", "repeat"]))
    packed = stats.groupBy(cluster).agg(F.collect_list(
        F.struct("arm", "repeat", "n", "sy", "syy", "sse")).alias("s"))  # arms x repeats
    ids = materialize(row_position(packed, [], [cluster], "pos").withColumn(
        "idx", F.col("pos") - 1).drop("pos"))
    n = ids.count()
    slots = ids.select(F.col("idx").alias("slot"),
                       F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    picks = slots.select("draw", hash_mod(n, tag, F.col("draw"), F.col("slot")).alias("idx"))
    # many slots of a draw pick few clusters when n is small: sum by multiplicity
    mult = picks.groupBy("draw", "idx").agg(F.count(F.lit(1)).alias("m"))
    rows = mult.join(broadcast_if_small(ids.select("idx", "s")), "idx").select(
        "draw", "m", F.explode("s").alias("s"))
    m = F.col("m")
    sums = rows.groupBy("draw", "s.arm", "s.repeat").agg(
        F.sum(m * F.col("s.n")).alias("n"), F.sum(m * F.col("s.sy")).alias("sy"),
        F.sum(m * F.col("s.syy")).alias("syy"), F.sum(m * F.col("s.sse")).alias("sse"))
    r2 = sums.withColumn("r2", r2_from_sums(F.col("n"), F.col("sy"), F.col("syy"), F.col("sse")))
    return r2.groupBy("draw", "arm").agg(F.avg("r2").alias("r2"))


def paired_delta(boot: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return boot.groupBy(*keys, "draw").agg(
        (F.min(F.when(F.col("arm") == a, F.col("r2")))
         - F.min(F.when(F.col("arm") == b, F.col("r2")))).alias("delta")).where("delta is not null")


def bootstrap_summary(delta: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Median, percentile interval, shares of either sign and the raw p-value."""
    named = list(keys or [])
    keys = named or ["__all"]
    if not named:
        delta = delta.withColumn("__all", F.lit(0))
    q = exact_quantiles(delta, keys, "delta", {"ci_low": 0.025, "median": 0.5, "ci_high": 0.975})
    s = delta.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_effective"),
        F.avg((F.col("delta") > 0).cast("int")).alias("frac_positive"),
        (2.0 * F.least(F.avg((F.col("delta") <= 0).cast("int")),
                       F.avg((F.col("delta") >= 0).cast("int")))).alias("p_raw"))
    j = s.join(q, keys).withColumn("p_raw", F.least(F.lit(1.0), F.col("p_raw")))
    return j if named else j.drop("__all")


def stable_flag(point: Column, median: Column, low: Column, high: Column) -> Column:
    return ~((high - low > 1.0) | (F.abs(median - point) > 0.05))


# ---- multiplicity -----------------------------------------------------------------


def holm(df: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    """Step-down adjusted p-values per family."""
    m = df.groupBy(*family).agg(F.count(F.lit(1)).alias("__m"))
    placed = row_position(df, family, [p, tie], "__k").join(m, family)
    raw = F.col(p) * (F.col("__m") - F.col("__k") + 1)
    out = scan(placed, family, [p, tie], {"p_holm": ("max", raw)})
    return out.withColumn("p_holm", F.least(F.lit(1.0), F.col("p_holm"))).drop("__m", "__k")


def benjamini_hochberg(df: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    """Step-up adjusted p-values per family."""
    m = df.groupBy(*family).agg(F.count(F.lit(1)).alias("__m"))
    placed = row_position(df, family, [p, tie], "__k").join(m, family)
    raw = F.col(p) * F.col("__m") / F.col("__k")
    down = placed.withColumn("__neg", -F.col("__k"))
    out = scan(down, family, ["__neg"], {"q_bh": ("min", raw)})
    return out.withColumn("q_bh", F.least(F.lit(1.0), F.col("q_bh"))).drop("__m", "__k", "__neg")


def bonferroni(p: Column, n: int) -> Column:
    return F.least(F.lit(1.0), p * n)


# ---- AUC ---------------------------------------------------------------------------


def auc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve per group from average ranks.

    Counts per distinct score come first, so ties and hot groups collapse.
    """
    c = df.groupBy(*keys, score).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n_at"))
    run = scan(materialize(c), keys, [score], {"upto": ("sum", F.col("n_at"))})
    rank = F.col("upto") - F.col("n_at") + (F.col("n_at") + 1) / 2.0
    s = run.groupBy(*keys).agg(
        F.sum(F.col("pos") * rank).alias("rs"), F.sum("pos").alias("np"),
        F.sum(F.col("n_at") - F.col("pos")).alias("nn"))
    return s.select(*keys, F.col("np").alias("n_pos"), F.col("nn").alias("n_neg"), F.when(
        (F.col("np") > 0) & (F.col("nn") > 0),
        (F.col("rs") - F.col("np") * (F.col("np") + 1) / 2.0) / (F.col("np") * F.col("nn")))
        .alias("auc"))


def threshold_scores(df: DataFrame, keys: list[str], label: str, score: str, cut: float = 0.5
                     ) -> DataFrame:
    hit = F.col(score) >= cut
    pos = F.col(label) == 1
    return df.groupBy(*keys).agg(
        F.avg((hit == pos).cast("int")).alias("accuracy"),
        (F.count_if(hit & pos) / F.nullif(F.count_if(pos), F.lit(0))).alias("sensitivity"),
        (F.count_if(~hit & ~pos) / F.nullif(F.count_if(~pos), F.lit(0))).alias("specificity"))


def resample_counts(df: DataFrame, key: str, label: str, draws: int, tag: str) -> DataFrame:
    """(draw, key, m): stratified resample of the rows of every class, with multiplicity."""
    placed = materialize(row_position(df.select(key, label), [label], [key]).withColumn(
        "idx", F.col("pos") - 1).drop("pos"))
    n = placed.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    slots = placed.join(side_table(n), label).withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = slots.select("draw", label, hash_mod(
        F.col("n"), tag, F.col("draw"), F.col(label), F.col("idx")).alias("idx"))
    m = picks.groupBy("draw", label, "idx").agg(F.count(F.lit(1)).alias("m"))
    return m.join(placed, [label, "idx"]).select("draw", key, "m")


def slot_picks(tag: str, draw: int, label: str, n: int):
    """Rows 0..n-1 that the n slots of a class pick in a draw, ``SLOTS`` at a time: ``hash_mod``
    of (tag, draw, label, slot)."""
    if not _TAILS:
        _TAILS.extend(([b"%d" % i for i in range(SLOTS)], [b"%05d" % i for i in range(SLOTS)]))
    sha = hashlib.sha256
    for at in range(0, n, SLOTS):
        head = f"{tag}|{draw}|{label}|{at // SLOTS or ''}".encode()
        digests = b"".join([sha(head + t).digest() for t in _TAILS[at > 0][:n - at]])
        yield ((np.frombuffer(digests, ">u8")[::4] >> np.uint64(12)) % np.uint64(n)).astype(np.int64)


_TAILS: list[list[bytes]] = []  # digits of the slots, made once a Python worker


def packed_blocks(placed: DataFrame, keys: list[str], idx: str, value: str, dtype: str) -> DataFrame:
    """(keys, block, data): values in the order of ``idx`` as bytes, ``SLOTS`` to a block."""
    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf.sort_values(idx)[value].to_numpy(dtype).tobytes()
        return pd.DataFrame([(*key, data)], columns=[*keys, "block", "data"])

    blocks = placed.withColumn("block", F.floor(F.col(idx) / SLOTS).cast("int"))
    schema = blocks.select(*keys, "block").schema.add("data", "binary")
    return blocks.groupBy(*keys, "block").applyInPandas(pack, schema)


def draw_shares(spark, draws: int, parts: int) -> DataFrame:
    """(first, end): the draws in ``parts`` tasks, more if there are cores, no more than draws."""
    parts = min(draws, max(2 * spark.sparkContext.defaultParallelism, parts))
    return spark.range(0, parts, 1, parts).select(
        F.expr(f"cast(id * {draws} div {parts} as int)").alias("first"),
        F.expr(f"cast((id + 1) * {draws} div {parts} as int)").alias("end"))


def on_draws(blocks: DataFrame, rows: int, draws: int, run, schema) -> DataFrame:
    """``run(first draw, end, blocks)`` in tasks that share the draws out; a draw is one task's.

    ``blocks`` are short of ``PACKED`` bytes in all and reach every task; what a task makes is
    never shuffled but for the rows that ``run`` gives.
    """
    shares = draw_shares(blocks.sparkSession, draws, rows * draws // TASK_PICKS)
    whole = blocks.agg(F.collect_list(F.struct(*blocks.columns)).alias("blocks"))

    def each(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                if len(r.blocks):
                    yield run(r.first, r.end, r.blocks)

    return shares.join(F.broadcast(whole)).mapInPandas(each, schema)


def auc_bootstrap(scores: DataFrame, key: str, label: str, draws: int, tag: str,
                  keys: list[str] | None = None) -> DataFrame:
    """(keys, draw, auc): every resample's AUC; all models share the resamples.

    A task makes whole draws on the rank of every row's distinct score, so a pick is a hash and
    a count in an array.  Beyond ``PACKED`` bytes of ranks, or if a key repeats within a model,
    the picks are joined instead.
    """
    keys = keys or []
    scores = scores.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    per = scores.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(
        F.lit(0), *keys)).alias("models"), F.min(label).alias("low"), F.max(label).alias("high")).agg(
        F.count(F.lit(1)).alias("n_keys"), F.max((F.col("n") > F.col("models")) | (F.col("low") != F.col("high"))).alias("odd")).first()
    models = side_table(scores.select(*keys).distinct()) if keys else None
    if per["odd"] or 4 * (per["n_keys"] or 0) * (models.count() if keys else 1) > PACKED:
        return joined_auc_bootstrap(scores, key, label, draws, tag, keys)
    ranks = row_position(scores.select(*keys, "score").distinct(), keys, ["score"], "rank")
    same = F.col("score").eqNullSafe(F.col("r_score"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    ranked = scores.join(ranks.select("rank", *[F.col(c).alias(f"r_{c}") for c in (*keys, "score")]), same).select(
        *keys, key, "rank")
    placed = materialize(row_position(scores.select(key, label).distinct(), [label], [key]).select(
        key, label, (F.col("pos") - 1).alias("idx")))
    every = placed.crossJoin(models) if keys else placed  # a model may lack a key
    mine = F.col(key) == F.col("r_key")
    for k in keys:
        mine = mine & F.col(k).eqNullSafe(F.col(f"m_{k}"))
    both = every.join(ranked.select(F.col(key).alias("r_key"), "rank", *[F.col(k).alias(f"m_{k}") for k in keys]), mine, "left")
    blocks = packed_blocks(both.select(*keys, label, "idx", F.coalesce("rank", F.lit(0)).cast("int").alias("rank")),
                           [*keys, label], "idx", "rank", "int32")
    blocks = blocks.select(*keys, F.col(label).cast("string").alias("label"), F.col(label).cast("double").alias("weight"),
                           "block", "data")
    schema = scores.select(*keys).schema.add("draw", "integer").add("auc", "double")

    def run(first, end, blocks):
        parts: dict[tuple, dict] = {}
        for b in sorted(blocks, key=lambda b: b["block"]):
            parts.setdefault(tuple(b[k] for k in keys), {}).setdefault((b["label"], b["weight"]), []).append(b["data"])
        tables = {m: {c: np.frombuffer(b"".join(d), np.int32) for c, d in of.items()} for m, of in parts.items()}
        size = {m: 1 + max(t.max() for t in of.values()) for m, of in tables.items()}
        classes = {c: len(t) for of in tables.values() for c, t in of.items()}
        out = []
        for draw in range(first, end):
            pos = {m: np.zeros(n) for m, n in size.items()}
            n_at = {m: np.zeros(n) for m, n in size.items()}
            for c, n in classes.items():
                for picks in slot_picks(tag, draw, c[0], n):
                    for m, of in tables.items():
                        found = np.bincount(of[c][picks], minlength=size[m])
                        n_at[m] += found
                        pos[m] += c[1] * found
            for m in tables:
                n, p = n_at[m][1:], pos[m][1:]  # rank 0: the model has no score of the key
                if not n.sum():
                    continue
                ranked_sum = (p * (np.cumsum(n) - n + (n + 1) / 2.0)).sum()
                np_, nn = p.sum(), (n - p).sum()
                out.append((*m, draw, (ranked_sum - np_ * (np_ + 1) / 2.0) / (np_ * nn) if np_ * nn else None))
        return pd.DataFrame(out, columns=[*keys, "draw", "auc"])

    return on_draws(blocks, placed.count(), draws, run, schema)


def joined_auc_bootstrap(scores: DataFrame, key: str, label: str, draws: int, tag: str,
                  keys: list[str] | None = None) -> DataFrame:
    """As :func:`auc_bootstrap` for tables of any size: every pick is a row that is joined."""
    keys = keys or []
    one = scores.select(key, label).dropDuplicates([key])
    m = resample_counts(one, key, label, draws, tag)
    j = scores.join(m, key)
    c = j.groupBy(*keys, "draw", "score").agg(
        F.sum(F.col("m") * F.col(label)).alias("pos"), F.sum("m").alias("n_at"))
    run = scan(materialize(c), [*keys, "draw"], ["score"], {"upto": ("sum", F.col("n_at"))})
    rank = F.col("upto") - F.col("n_at") + (F.col("n_at") + 1) / 2.0
    s = run.groupBy(*keys, "draw").agg(F.sum(F.col("pos") * rank).alias("rs"), F.sum("pos").alias("np"),
                                       F.sum(F.col("n_at") - F.col("pos")).alias("nn"))
    return s.select(*keys, "draw", ((F.col("rs") - F.col("np") * (F.col("np") + 1) / 2.0)
                                    / (F.col("np") * F.col("nn"))).alias("auc"))


# ---- enrichment against a pool of null paths ----------------------------------------


def enrichment(real: DataFrame, pool: DataFrame, cell: str, circuit: str, draws: int, tag: str
               ) -> DataFrame:
    """Mean circuit edges per path against null sets drawn from each cell's pool.

    ``real`` and ``pool`` have (cell, circuit, path_key, n_edges), zero counts
    included.  In every null set each real path of a cell picks one pool path; all circuits
    are measured on the same picks.  Cells without a pool are left out on both sides.
    """
    paths = pool.groupBy(cell, "path_key").agg(F.array_sort(F.collect_list(F.struct(
        F.col(circuit).alias("c"), F.col("n_edges").alias("n")))).alias("counts"))  # a path's circuits
    numbered = row_position(paths, [cell], ["path_key"])
    table = numbered.groupBy(cell).agg(F.array_sort(F.collect_list(F.struct("pos", "counts"))).alias("table"))  # a sample
    usable = materialize(real.join(table.select(cell), cell, "left_semi"))
    obs = usable.groupBy(circuit).agg(F.avg("n_edges").alias("observed"),
                                      F.count(F.lit(1)).alias("n_paths"))
    mine = usable.select(cell, "path_key").distinct().join(table, cell)
    pick = lambda d: F.element_at("table", (hash_mod(
        F.size("table"), tag, d, F.col("path_key")) + 1).cast("int"))["counts"]
    tasks = int(real.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, much work each
    drawn = mine.repartition(tasks, cell, "path_key").select(F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(draws - 1)), pick)).alias("draw", "counts"))
    null = drawn.select("draw", F.explode("counts").alias("e")).groupBy(
        F.col("e.c").alias(circuit), "draw").agg(F.avg("e.n").alias("null"))
    j = null.join(side_table(obs), circuit)
    return j.groupBy(circuit).agg(
        F.min("n_paths").alias("n_paths"), F.min("observed").alias("observed"),
        F.avg("null").alias("null_mean"),
        F.count_if(F.col("null") >= F.col("observed") - 1e-12).alias("n_extreme")).select(
        circuit, "n_paths", "observed", "null_mean",
        F.when(F.col("null_mean") > 0, F.col("observed") / F.col("null_mean")).alias("ratio"),
        ((1 + F.col("n_extreme")) / F.lit(draws + 1)).alias("p"))


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Every row with the average rank of its value within the group."""
    r = value_ranks(df, keys, value).select(*keys, value, F.col("avg_rank").alias(name))
    return df.join(r, [*keys, value])


def mean_difference_bootstrap(df: DataFrame, key: str, label: str, value: str, draws: int, tag: str
                              ) -> DataFrame:
    """(draw, delta): mean of class 1 minus mean of class 0 over stratified resamples.

    A task makes whole draws on the packed values; beyond ``PACKED`` bytes picks are joined.
    """
    placed = materialize(row_position(df.select(key, label, value), [label], [key]).withColumn(
        "idx", F.col("pos") - 1).select(label, "idx", value))
    rows = placed.count()
    if 9 * rows <= PACKED:
        return packed_mean_differences(placed, label, value, rows, draws, tag)
    n = placed.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism,
                rows * draws // TASK_PICKS)
    slots = placed.drop(value).join(side_table(n), label).repartition(parts).withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = slots.select("draw", label, hash_mod(
        F.col("n"), tag, F.col("draw"), F.col(label), F.col("idx")).alias("idx"))
    # the values meet the picks in the task that makes them: only sums by draw are shuffled
    got = picks.join(broadcast_if_small(placed), [label, "idx"])
    w = lambda c, x: F.sum(F.when(F.col(label) == c, x))
    mean = lambda c: w(c, F.col(value)) / w(c, F.lit(1))
    return got.groupBy("draw").agg((mean(1) - mean(0)).alias("delta"))


def packed_mean_differences(placed: DataFrame, label: str, value: str, rows: int, draws: int, tag: str) -> DataFrame:
    """(draw, delta) from rows (label, idx, value) that fit a task: whole draws in the JVM, where a pick takes
    a tenth of the time it takes in Python."""
    known = placed.where(F.col(label).isNotNull()).select(label, "idx", F.struct(
        F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.col(value).isNotNull().cast("double")).alias("v"))
    sides = {c: packed_blocks(known.select(label, "idx", F.col(f"v.col{i}").alias("x")), [label], "idx", "x", t)
             for i, (c, t) in enumerate((("value", "<f8"), ("seen", "int8")), 1)}
    blocks = sides["value"].join(sides["seen"].withColumnRenamed("data", "seen"), [label, "block"]).select(
        F.col(label).cast("string").alias("label"), "block", F.col(label).cast("double").alias("class"), "data", "seen")
    whole = blocks.agg(F.array_sort(F.collect_list(F.struct(*blocks.columns))).alias("blocks")).where(F.size("blocks") > 0)
    spark = placed.sparkSession
    deltas = java_function(spark, "MeanDifferences", ArrayType(DoubleType()))
    shares = draw_shares(spark, draws, rows * draws // JAVA_PICKS).join(F.broadcast(whole))
    return shares.select("first", F.posexplode(deltas(F.lit(tag), "first", "end", "blocks")).alias("nth", "delta")).select(
        (F.col("first") + F.col("nth")).alias("draw"), "delta")
