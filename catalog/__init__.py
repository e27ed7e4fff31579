"""Query catalogue: one module per operator group."""

from __future__ import annotations

import importlib

MODULES = ["sources", "cleaning", "ordered", "features", "profiling", "evaluation", "domain", "modelling", "plans", "live"]


def load():
    from . import base

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return base.QUERIES, base.ORACLES
