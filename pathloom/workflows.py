"""Named workflows: ordered stages, each a registered query written as a table.

    python -m pathloom.workflows main_prediction --data DIR --out DIR --check
    python -m pathloom.workflows main_prediction --data DIR --out DIR --execute [--from-step N]

A finished stage is reused as long as the content of the tables is the same; with other tables
another output folder is needed.  Outputs are never overwritten in place.
"""

from __future__ import annotations

import argparse
import sys

from pathloom.plans import load_all
from pathloom.plans.provenance_queries import TABLES
from pathloom.sources.provenance import content_sums
from pathloom.sources.sinks import exists, stage, write_once

WORKFLOWS: dict[str, list[str]] = {
    "main_prediction": ["path_support_by_length", "retention_tables", "design_matrix", "fold_manifest",
                        "elasticnet_cv", "metric_block", "cluster_bootstrap", "holm", "bh"],
    "sensitivity": ["density_sweep", "bin_width_sensitivity", "pathset_jaccard", "relaxed_ladder"],
    "controls": ["control_sweep", "order_shuffle", "edge_shuffle", "latency_null_search", "sc_rewire", "matched_random",
                 "matched_random_walks", "legendre_edge_shuffled"],
    "domain_classification": ["mode_shares", "confounder_block", "coverage", "logistic_cv", "lodo_split",
                              "stratified_match", "smd_table", "auc_delta_paired", "feature_importance",
                              "summary_tables"],
    "insilico": ["group_means", "target_selection", "displacement_sr", "exact_labelings",
                 "permanova_f", "manova", "kmeans", "ward"],
    "anatomical_enrichment": ["circuit_edges", "enrichment"],
    "signal_detection": ["baseline_zscore", "onset_peak", "response_matrix"],
    "linked_inference": ["pair_validation", "unit_contributions", "signflip_linked"],
    "mode_attribution": ["prefix_subpaths", "per_length_models", "dominant_mode", "mode_by_length",
                         "path_transition", "accumulation", "participation"],
}


def resolve(workflow: str, step: str | None = None, from_step: str | None = None) -> list[str]:
    """Stage names; a step is a name or a 1-based number."""
    stages = WORKFLOWS[workflow]

    def at(s: str) -> int:
        i = int(s) - 1 if s.isdigit() else stages.index(s) if s in stages else -1
        if not 0 <= i < len(stages):
            raise ValueError(f"{workflow} has no step {s}")
        return i

    if step and from_step:
        raise ValueError("give either a step or a first step")
    if step:
        return [stages[at(step)]]
    return stages[at(from_step):] if from_step else list(stages)


def check() -> list[str]:
    """Stages that name no registered query."""
    queries, _ = load_all()
    return [f"{w}: {s}" for w, st in WORKFLOWS.items() for s in st if s not in queries]


def bind_inputs(spark, data: str, out: str) -> None:
    """The first run of a folder notes the content of its tables, later ones must find it again."""
    rows = [(t, *content_sums(spark.read.parquet(f"{data}/{t}.parquet")).first()) for t in (*TABLES, "embeddings")]
    path = f"{out.rstrip('/')}/inputs"
    if not exists(spark, path):
        write_once(spark.createDataFrame(rows, "table_name string, n_rows long, w0 long, w1 long, w2 long, w3 long").coalesce(1),
                   path)
        return
    noted = {tuple(r) for r in spark.read.parquet(path).collect()}  # one short row a table
    changed = sorted(r[0] for r in rows if r not in noted)
    if changed:
        raise ValueError(f"{out} holds stages of other content of: {', '.join(changed)}")


def run(spark, stages: list[str], data: str, out: str, log=print) -> None:
    queries, _ = load_all()
    bind_inputs(spark, data, out)
    for name in stages:
        path = f"{out.rstrip('/')}/{name}"
        reused = exists(spark, path)
        stage(spark, path, lambda: queries[name](spark, data))
        log(f"{name}: {'reused' if reused else 'written'} {path}")


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="pathloom.workflows")
    ap.add_argument("workflow", choices=sorted(WORKFLOWS))
    ap.add_argument("--data")
    ap.add_argument("--out")
    ap.add_argument("--step")
    ap.add_argument("--from-step")
    mode = ap.add_mutually_exclusive_group(required=True)
    mode.add_argument("--check", action="store_true")
    mode.add_argument("--dry-run", action="store_true")
    mode.add_argument("--execute", action="store_true")
    args = ap.parse_args(argv)
    stages = resolve(args.workflow, args.step, args.from_step)
    if args.check:
        missing = check()
        print("\n".join(missing) or "ok")
        return 1 if missing else 0
    if args.dry_run:
        print("\n".join(stages))
        return 0
    if not args.data or not args.out:
        ap.error("--execute needs --data and --out")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"pathloom-{args.workflow}").getOrCreate()
    run(spark, stages, args.data, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
