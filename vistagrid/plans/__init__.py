"""Registered queries, one module per subject."""

from __future__ import annotations

import importlib
from types import ModuleType

MODULES = ["scalar_plans", "tile_plans", "source_plans", "analytics_plans", "enrich_plans", "path_plans", "request_plans", "option_plans",
           "quality_plans", "stream_plans", "explain_plans", "ring_plans", "evaluation_plans", "wording_plans"]


def load_all() -> ModuleType:
    """Import every plan module once and return the registry."""
    for name in MODULES:
        importlib.import_module(f"vistagrid.plans.{name}")
    return importlib.import_module("vistagrid.plans.registry")
