"""Named queries over the driver tables."""

import importlib

MODULES = ["text_queries", "vector_queries", "relational_queries", "rule_queries", "statistics_queries", "experiment_queries", "source_queries", "closed_form_queries", "probe_queries", "resampling_queries", "store_queries"]


def load():
    """The registry, with every module of queries imported."""
    for name in MODULES:
        importlib.import_module(f"pairloom.plans.{name}")
    return importlib.import_module("pairloom.plans.registry")
