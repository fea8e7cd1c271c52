"""Every query of the library with its SQL statement."""

from __future__ import annotations

import importlib

MODULES = ["text_queries", "manifest_queries", "package_queries", "dependency_queries", "surface_queries", "composite_queries"]


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{m}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
