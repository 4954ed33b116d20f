"""Operators for training-data pipelines; nothing else in the library imports this."""

from importlib import import_module

MODULES = ["ngram_join", "html_text", "fingerprint", "quality", "token_counts", "bpe", "language_id",
           "exact_dedup", "url_filter", "packing", "filter_audit", "periodic_runs", "sentence_pieces"]


def load_all():
    """(queries, oracles) by name, the pipeline included."""
    from corpus_pipeline import ORACLE_SQL, run

    queries, oracles = {"pipeline": run}, {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
    for m in MODULES:
        mod = import_module(f"pathloom.llm.{m}")
        queries.update(mod.QUERIES)
        oracles.update(getattr(mod, "ORACLES", {}))
    return queries, oracles
