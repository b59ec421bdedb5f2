"""Registered queries over the given tables, each with the SQL it must agree with."""
from __future__ import annotations

import importlib

MODULES = ("windows", "joins", "quality", "trading", "market", "signals", "audits", "sources")


def _merge(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"barflow.catalog.{name}"), attribute))
    return dict(sorted(out.items()))


def all_queries() -> dict:
    return _merge("QUERIES")


def all_oracles() -> dict:
    return _merge("ORACLES")
