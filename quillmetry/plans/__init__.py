"""Query plans: what the engine registers for callers."""

from __future__ import annotations

import importlib
from types import ModuleType

#: Modules that register the core's queries.
MODULES = ["time_queries", "relational_queries", "text_queries", "series_queries", "corpus_queries", "convergence_queries", "storage_queries", "analysis_queries", "report_queries"]


def load() -> ModuleType:
    """Import every module of queries and return the catalogue."""
    for m in MODULES:
        importlib.import_module(f"quillmetry.plans.{m}")
    return importlib.import_module("quillmetry.plans.catalog")
