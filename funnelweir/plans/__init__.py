"""Jobs and registered queries."""

from __future__ import annotations

import importlib

MODULES = ["cleaning", "features", "inference", "models", "evaluation", "flagship"]


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"funnelweir.plans.{name}")
