"""Registered queries over the star-schema tables."""

from importlib import import_module

MODULES = ["graph_queries", "screen_queries", "feature_queries", "metric_queries", "inference_queries", "cohort_queries", "model_queries", "transfer_queries", "null_search_queries", "conditional_queries", "permutation_queries", "provenance_queries"]


def load_all():
    """(queries, oracles) by name."""
    from pathloom.plans.registry import ORACLES, QUERIES

    for m in MODULES:
        import_module(f"pathloom.plans.{m}")
    return QUERIES, ORACLES
