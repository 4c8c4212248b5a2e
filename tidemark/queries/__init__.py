"""Named queries over the given tables, each with equivalent check SQL where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = ("market", "ledger", "scores", "backtests", "household", "macro", "news", "live")


def load_registry():
    for module in MODULES:
        importlib.import_module(f"tidemark.queries.{module}")
    from tidemark.queries.registry import REGISTRY
    return REGISTRY
