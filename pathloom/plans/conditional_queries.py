"""Endpoint, summary and ordered-basis arms of the cells, refitted at the endpoint arm's choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import conditional as Co
from pathloom.operators import features as V
from pathloom.operators import folds as Fo
from pathloom.operators import metrics as Me
from pathloom.operators import models as Mo
from pathloom.plans import fixture as fx
from pathloom.plans.feature_queries import CELL, sampled
from pathloom.plans.registry import query
from pathloom.session import materialize


def arms(spark, sf):
    """(cells with outcome, columns by arm): C4 the endpoint block, C6 with the 56 summary
    statistics of the sampled paths, C8R with the 32 of the ordered basis."""
    e, _, p = sampled(spark, sf)
    p = materialize(p)
    c4 = V.endpoint_block(p.select(*CELL).distinct(), e, fx.MAX_LEN)
    out = e.select(F.col("u").alias("seed"), F.col("v").alias("endpoint"), "y").join(c4, ["seed", "endpoint"])
    base = [c for c in c4.columns if c not in CELL]
    columns = {"C4": base}
    for arm, block in (("C6", V.blind_stats(p, CELL)), ("C8R", V.legendre_features(p, CELL, fx.MAX_LEN))):
        names = [c for c in block.columns if c not in CELL]
        out = out.join(block.select(*CELL, *[F.col(c).alias(f"{arm}_{c}") for c in names]), CELL, "left")
        columns[arm] = base + [f"{arm}_{c}" for c in names]
    return materialize(out.withColumn("sample_id", F.concat_ws("|", *CELL))), columns


def fitted(spark, sf):
    df, columns = arms(spark, sf)
    sizes = materialize(df.groupBy("seed").agg(F.count(F.lit(1)).alias("size")))
    outer = Fo.grouped_folds(sizes, "seed", fx.REPEATS, fx.FOLDS, "cells")
    assign = materialize(Mo.hashed_inner_folds(outer, "seed", fx.FOLDS, fx.FOLDS, "cells-inner"))
    fits = Co.conditional_fits(df, assign, "seed", "y", ("C4", columns["C4"]), {a: columns[a] for a in ("C6", "C8R")})
    return df, columns, assign, fits


FOLD_SQL = f"""
g as (select seed grp, count(*)::bigint size from (select distinct seed, endpoint, L from path) group by 1),
o as (select r::int repeat, grp, size, row_number() over (partition by r
        order by size desc, sha256('cells|' || r || '|' || grp), grp) i from g, range({fx.REPEATS}) t(r)),
st as (
  select repeat, 1 i, 0 fold, grp, size, [size, 0, 0, 0, 0]::bigint[] loads from o where i = 1
  union all
  select repeat, i + 1, p - 1, grp, size, list_transform(loads, lambda x, k: x + case when k = p then size else 0 end)
  from (select s.repeat, s.i, o.grp, o.size, s.loads, list_position(s.loads, list_min(s.loads)) p
        from st s join o on o.repeat = s.repeat and o.i = s.i + 1))"""


@query("conditional_optimality", fx.WITH_PATH + "," + FOLD_SQL + f"""
select arm, repeat, f::int outer_fold, sum(size) filter (fold <> f)::bigint n_train, true optimal
from st, range({fx.FOLDS}) t(f), (select unnest(['C4', 'C6', 'C8R']) arm) group by arm, repeat, f""")
def conditional_optimality(spark, sf):
    """Every fit with the size of its training set; its conditions recomputed from the rows hold."""
    df, columns, assign, fits = fitted(spark, sf)
    out = None
    for arm, names in columns.items():
        v = Co.elastic_net_violations(df, assign, fits.where(F.col("arm") == arm), "seed", names, "y")
        v = v.select(F.lit(arm).alias("arm"), "repeat", "outer_fold", "n_train", (F.col("violation") < 1e-6).alias("optimal"))
        out = v if out is None else out.unionByName(v)
    return out


@query("conditional_metrics")
def conditional_metrics(spark, sf):
    """Fit of the three arms: mean R2 over repeats, and each arm's gain over the endpoint arm."""
    df, columns, assign, fits = fitted(spark, sf)
    oof = None
    for arm, names in columns.items():
        part = Mo.predict_oof(df, assign, fits.where(F.col("arm") == arm), "sample_id", "seed", names, "y").withColumn("arm", F.lit(arm))
        oof = part if oof is None else oof.unionByName(part)
    r = Me.repeat_r2(materialize(oof), ["arm"])
    base = r.where("arm = 'C4'").select(F.col("r2").alias("base"))  # one row
    return r.join(F.broadcast(base)).select("arm", F.round("r2", 6).alias("r2"), F.round(F.col("r2") - F.col("base"), 6).alias("gain"))
