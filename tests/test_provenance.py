import pytest
from pyspark.sql import functions as F

from pathloom.sources import provenance as V


def test_sums_hold_for_any_order_and_see_every_change(spark):
    rows = [(1, "a", 0.5), (2, None, None), (2, None, None), (3, "", 1.5)]
    sums = lambda r: V.content_sums(spark.createDataFrame(r, "k int, s string, x double")).first()
    own = sums(rows)
    assert own == V.content_sums(spark.createDataFrame(rows[::-1], "k int, s string, x double").select("x", "s", "k")
                                 .repartition(5)).first()
    assert own["n_rows"] == 4 and tuple(sums([])) == (0,) * 5
    for other in (rows[:3], rows + rows[:1], [(1, "a", 0.25)] + rows[1:], rows[:3] + [(3, None, 1.5)]):
        assert sums(other) != own
    nested = spark.sql("select array(1, null) a, timestamp'2024-01-01 00:00:00' t")
    assert V.content_sums(nested).first()["n_rows"] == 1


def test_stage_is_built_once_an_input(spark, tmp_path):
    made = []

    def stage(rows, conditions=None, version="1"):
        df = spark.createDataFrame(rows, "k int, x double")
        return V.keyed_stage(spark, str(tmp_path), "totals", lambda: made.append(1) or df.groupBy("k").agg(
            F.sum("x").alias("x")), {"rows": df}, conditions, version)

    rows = [(1, 1.0), (1, 2.0), (2, 5.0)]
    two = {"two keys": F.count(F.lit(1)) == 2, "all finite": F.count_if(F.isnan("x") | F.col("x").isNull()) == 0}
    assert sorted(map(tuple, stage(rows, two).collect())) == [(1, 3.0), (2, 5.0)]
    assert stage(rows[::-1], two).count() == 2 and len(made) == 1
    assert sorted(map(tuple, stage(rows + [(2, 1.0)], two).collect())) == [(1, 3.0), (2, 6.0)] and len(made) == 2
    stage(rows, two, version="2")
    assert len(made) == 3 and len(list(tmp_path.iterdir())) == 3
    with pytest.raises(ValueError, match="two keys"):
        stage(rows + [(3, 1.0)], two)
    with pytest.raises(ValueError, match="two keys"):  # also when it is there already
        stage(rows + [(3, 1.0)], two)
    with pytest.raises(ValueError, match="largest"):
        stage([], {"largest": F.max("x") > 0})
