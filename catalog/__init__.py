"""Registered queries and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["windows", "scans", "features", "crosssection", "training", "reports"]


def load():
    from .registry import QUERIES
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return QUERIES
