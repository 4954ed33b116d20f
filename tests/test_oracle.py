"""Registered queries against their SQL oracles on the smallest tables.

A cross-section runs by default; PATHLOOM_ALL_ORACLES=1 runs every query (use
tools/compare.py for timings and other scale factors).
"""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from compare import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
QUICK = ["edge_matrix", "dag_edges", "path_registry", "rank_sample", "screen_b5", "relaxed_ladder",
         "blind_stats", "legendre_edge_shuffled", "order_shuffle", "edge_jaccard", "routing_efficiency",
         "navigation", "onset_peak", "nearest_centroid_grid", "fold_manifest", "pair_validation",
         "cluster_bootstrap", "signflip_linked", "holm", "bh", "auc_bootstrap", "stratified_match",
         "displacement_sr", "mode_by_length", "accumulation", "participation", "train_medians"]
NAMES = list(entry.queries()) if os.environ.get("PATHLOOM_ALL_ORACLES") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    status, _, _, message = compare(spark, con, name, SF)
    assert status in ("ok", "rows"), message


def test_registry_is_consistent(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["L", "n_cells", "n_supported", "fraction"] and df.count() > 0
