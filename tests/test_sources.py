import json

import numpy as np
import pytest

from pathloom.operators import signals as Sg
from pathloom.sources import readers as R
from pathloom.sources import sinks as K


def test_tables(spark, tmp_path):
    p = tmp_path / "folds.csv"
    p.write_text("repeat,sample_id,seed_roi,test_fold\n0,a,A,1\n1,b,B,2\n")
    df = R.read_csv(spark, str(p), R.SCHEMAS["folds"], ["sample_id", "test_fold"])
    assert sorted(map(tuple, df.collect())) == [("a", 1), ("b", 2)]
    t = tmp_path / "e.tsv"
    t.write_text("name\tx\nE1\t0.5\n")
    assert R.read_tsv(spark, str(t), "name string, x double").first() == ("E1", 0.5)


def test_parquet_prunes_and_pushes(spark):
    df = R.read_parquet(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_orderkey"], "l_linenumber = 2")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_linenumber,2)" in plan
    assert "l_comment" not in plan and "l_tax" not in plan


def test_matrices(spark, tmp_path):
    m = tmp_path / "m.csv"
    m.write_text("0,1.5\nnan,inf\n")
    got = {(r["u"], r["v"]): r["value"] for r in R.read_matrix(spark, str(m)).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 1.5, (1, 0): None, (1, 1): None}
    i = tmp_path / "i.csv"
    i.write_text(",a,b\na,,2\nb,3,4\n")
    got = {(r["u"], r["v"]): r["value"] for r in R.read_matrix(spark, str(i), indexed=True).collect()}
    assert got == {(0, 0): None, (0, 1): 2.0, (1, 0): 3.0, (1, 1): 4.0}
    w = tmp_path / "w.txt"
    w.write_text("0.5 -1\n  1e-2   3\n")
    got = {(r["u"], r["v"]): r["value"]
           for r in R.read_text_matrix(spark, str(w), negative_is_missing=True).collect()}
    assert got == {(0, 0): 0.5, (0, 1): None, (1, 0): 0.01, (1, 1): 3.0}


def test_list_and_config(spark, tmp_path):
    p = tmp_path / "roi.txt"
    p.write_text("V1\n\n V2 \n")
    assert sorted(map(tuple, R.read_list(spark, str(p)).collect())) == [(0, "V1"), (1, "V2")]
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"k": 1}))
    assert R.read_config(str(c), ("k",)) == {"k": 1}
    with pytest.raises(ValueError):
        R.read_config(str(c), ("missing",))


def test_cubes_and_discovery(spark, tmp_path):
    rng = np.random.default_rng(0)
    cube = rng.normal(size=(2, 3, 1001))
    cube[1, 2, 350] = 80.0  # t = 50 ms
    np.save(tmp_path / "sub-07_task_run-2.npy", cube)
    (tmp_path / "other.npy").write_bytes(b"x")
    d = R.discover(spark, str(tmp_path), r"sub-(\d+)_task_run-(\d+)\.npy", ["subject", "run"])
    assert [(r["subject"], r["run"]) for r in d.collect()] == [("07", "2")]
    c = R.read_signal_cubes(spark, str(tmp_path / "sub-*.npy"))
    assert c.count() == 6
    ev = Sg.detect_events(R.signal_long(c), ["trial", "channel"]).where("significant").collect()
    assert [(r["trial"], r["channel"], r["onset"], r["peak"]) for r in ev] == [(1, 2, 50.0, 50.0)]


def test_path_sets(spark):
    p = spark.createDataFrame([("0|3|2", 2, [0, 2, 3]), ("0|3|2", 2, [0, 1, 3])],
                              "sample_id string, L int, nodes array<int>")
    rows = R.path_set_rows(p)
    assert sorted((r["path_index"], r["roi_id_sequence"]) for r in rows.collect()) == [
        (0, "0|1|3"), (1, "0|2|3")]
    back = R.path_set_nodes(rows)
    assert sorted(r["nodes"] for r in back.collect()) == [[0, 1, 3], [0, 2, 3]]


def test_write_once_and_stage(spark, tmp_path):
    df = spark.range(5)
    out = str(tmp_path / "t")
    K.write_once(df, out)
    with pytest.raises(Exception, match="exist"):
        K.write_once(df, out)
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    s = str(tmp_path / "s")
    assert K.stage(spark, s, build).count() == 3 and K.stage(spark, s, build).count() == 3
    assert len(calls) == 1


def test_matrix_text_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 0.5), (1, 0, None), (1, 1, 2.0)], "r int, c int, x double")
    K.write_matrix(df, "r", "c", "x", [0, 1], str(tmp_path / "m"))
    got = [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert sorted(got) == ["nan 0.500000", "nan 2.000000"]
    K.write_json_report({"a": 1}, str(tmp_path / "r.json"))
    with pytest.raises(FileExistsError):
        K.write_json_report({"a": 1}, str(tmp_path / "r.json"))
    assert "| r | c | x |" in K.markdown_table(df)
    with pytest.raises(ValueError):
        K.markdown_table(df, limit=2)


def test_fingerprints_ignore_order(spark):
    a = spark.range(100).withColumnRenamed("id", "k")
    b = a.repartition(7)
    assert K.table_fingerprint(a) == K.table_fingerprint(b)
    assert K.table_fingerprint(a) != K.table_fingerprint(a.where("k < 99"))


def test_workflows(spark, tmp_path, capsys):
    from pathloom import workflows as W

    assert W.check() == []
    assert W.resolve("linked_inference", from_step="2") == ["unit_contributions", "signflip_linked"]
    assert W.resolve("linked_inference", step="pair_validation") == ["pair_validation"]
    with pytest.raises(ValueError):
        W.resolve("linked_inference", step="9")
    assert W.main(["linked_inference", "--dry-run"]) == 0
    log = []
    for _ in range(2):
        W.run(spark, ["unit_contributions"], "/root/testdata/sf0.001", str(tmp_path), log.append)
    assert "written" in log[0] and "reused" in log[1]
    with pytest.raises(ValueError, match="lineitem"):  # stages of other tables are not mixed in
        W.run(spark, ["unit_contributions"], "/root/testdata/sf0.01", str(tmp_path), log.append)
    assert len(log) == 2
