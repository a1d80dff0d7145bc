"""Operators of a training-data pipeline, each with its query. Nothing outside this folder imports it."""

from importlib import import_module

from tidegauge.llm.common import ORACLES, QUERIES

MODULES = ("topk", "packing", "sharding", "quality", "rules", "wrappers", "toxicity", "tokencounts", "neardup", "mixing", "caps", "whitening", "lexical")


def load() -> tuple[dict, dict]:
    """All queries of this package by name, and the SQL of those that SQL can express."""
    for module in MODULES:
        import_module(f"tidegauge.llm.{module}")
    return QUERIES, ORACLES
