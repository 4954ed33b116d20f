"""Resampling from counts: a draw costs what the distinct scores cost, not what the rows do."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.ordered import row_position
from pathloom.session import materialize

BLOCK = 4096        # distinct scores that one task resamples together
DRAWS_AT_ONCE = 64  # rows of a block's table of draws in memory


def _rng(*parts) -> np.random.Generator:
    """The same numbers for the same parts, on any executor and at any attempt."""
    return np.random.Generator(np.random.Philox(int.from_bytes(
        hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")))


def auc_draws(scores: DataFrame, label: str, score: str, draws: int, tag: str, keys: list[str]) -> DataFrame:
    """(keys, draw, auc): AUC of stratified resamples of the rows of every group.

    Drawing n rows of a class with replacement is a multinomial over the counts of its
    distinct scores.  Scores are cut in their order into blocks of ``BLOCK``.  A draw first
    deals the class sizes over the blocks, the same in every task, then a block deals its own
    share over its scores.  Pairs across blocks follow from the block totals, so tasks send
    one row a draw.  Ties count half.  Groups without both classes or with a missing key give
    no rows.
    """
    counted = scores.groupBy(*keys, score).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))
    placed = materialize(row_position(counted, keys, [score], "at").withColumn("block", F.expr(f"(at - 1) div {BLOCK}")))
    totals = placed.groupBy(*keys, "block").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("block", "p", "n"))).alias("blocks"))  # distinct scores / BLOCK entries
    one = placed.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("at", "pos", "neg"))).alias("cells"))
    schema = one.select(*keys).schema.add("draw", "integer").add("wins", "double").add("pairs", "double")
    names = schema.names

    def resample(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                all_p, all_n = (np.array([b[c] for b in r["blocks"]], np.int64) for c in "pn")
                if not all_p.sum() or not all_n.sum():
                    continue
                group = [r[k] for k in keys]
                pos, neg = (np.array([c[k] for c in r["cells"]], np.int64) for k in ("pos", "neg"))
                me = [b["block"] for b in r["blocks"]].index(r["block"])
                out = []
                for d in range(0, draws, DRAWS_AT_ONCE):
                    m = min(DRAWS_AT_ONCE, draws - d)
                    shared, own = _rng(tag, *group, d), _rng(tag, *group, d, r["block"])
                    deal_p = shared.multinomial(all_p.sum(), all_p / all_p.sum(), m)
                    deal_n = shared.multinomial(all_n.sum(), all_n / all_n.sum(), m)
                    p = own.multinomial(deal_p[:, me], pos / max(1, pos.sum()) if pos.sum() else np.r_[1.0, np.zeros(len(pos) - 1)])
                    n = own.multinomial(deal_n[:, me], neg / max(1, neg.sum()) if neg.sum() else np.r_[1.0, np.zeros(len(neg) - 1)])
                    below = np.cumsum(n, axis=1) - n
                    wins = (p * (below + n / 2.0)).sum(axis=1) + deal_p[:, me] * deal_n[:, :me].sum(axis=1)
                    out.append(pd.DataFrame({**{k: [v] * m for k, v in zip(keys, group)}, "draw": np.arange(d, d + m, dtype=np.int32),
                                             "wins": wins, "pairs": float(all_p.sum()) * float(all_n.sum())}))
                yield pd.concat(out)[names]

    return one.join(totals, keys).repartition(*keys, "block").mapInPandas(resample, schema).groupBy(*keys, "draw").agg(
        (F.sum("wins") / F.max("pairs")).alias("auc"))


def intervals(draws: DataFrame, keys: list[str], value: str = "auc") -> DataFrame:
    """Mean, spread and the 95 % percentile interval of the draws of every group."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_draws"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                                    q[0].alias("ci_low"), q[1].alias("ci_high"))
