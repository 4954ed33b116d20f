import numpy as np
from pyspark.sql import functions as F

from pathloom.operators import folds as Fo
from pathloom.operators import models as Mo


def table(spark, n=400):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 2))
    y = x @ [1.5, -0.5] + rng.normal(size=n)
    return spark.createDataFrame([(i, i % 40, float(a) if i % 7 else None, float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))],
                                 "id int, grp int, a double, b double, y double")


def fits(df, assign):
    chosen = assign.select("repeat", "outer_fold").distinct().select("*", F.lit(0.01).alias("alpha"), F.lit(0.5).alias("l1_ratio"))
    return Mo.fixed_fits(df, assign, chosen, "grp", ["a", "b"], "y")


def rows(f):
    return {(r["repeat"], r["outer_fold"]): [*r["coef"], *r["fill"]] for r in f.collect()}


def test_inner_folds_have_no_say_and_labels_are_made_once(spark, monkeypatch):
    df = table(spark)
    outer = Fo.grouped_folds(df.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "grp", 2, 4, "t")
    plain, nested = Mo.outer_sets(outer, "grp", 4), Mo.hashed_inner_folds(outer, "grp", 3, 4, "i")
    made, before = [], Mo.set_labels
    monkeypatch.setattr(Mo, "set_labels", lambda *a: (made.append(1), before(*a))[1])
    one = fits(df, plain)
    assert len(made) == 1
    a, b = rows(one), rows(fits(df, nested))
    assert len(a) == 8 and a.keys() == b.keys()
    for k in a:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-9)

    pdf, where = df.toPandas().set_index("id"), {(r["repeat"], r["grp"]): r["test_fold"] for r in outer.collect()}
    got = Mo.predict_oof(df, plain, one, "id", "grp", ["a", "b"], "y").collect()
    assert len(got) == 2 * len(pdf)
    for r in got:
        assert where[r["repeat"], r["grp"]] == r["outer_fold"]
        c, own = a[r["repeat"], r["outer_fold"]], pdf.loc[r["sample_id"]]
        x = c[3] if np.isnan(own["a"]) else own["a"]
        np.testing.assert_allclose(r["y_pred"], c[0] + c[1] * x + c[2] * own["b"], rtol=1e-12)
    train = pdf[[where[0, g] != 1 for g in pdf["grp"]]]
    assert a[0, 1][3] == train["a"].median()


def test_groups_may_be_missing_from_some_sets(spark):
    df = table(spark)
    outer = Fo.grouped_folds(df.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "grp", 1, 4, "t")
    assign = Mo.outer_sets(outer, "grp", 4).where("not (outer_fold = 2 and grp < 10)")
    got, less = rows(fits(df, assign)), rows(fits(df.where("grp >= 10"), Mo.outer_sets(outer, "grp", 4)))
    np.testing.assert_allclose(got[0, 2], less[0, 2], rtol=1e-9)
