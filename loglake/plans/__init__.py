"""The catalogue of ready queries, each with the SQL its result is checked against."""

from __future__ import annotations

import importlib

_GROUPS = ("parsing", "rollups", "issues", "search", "series", "process", "compliance",
           "usage", "reports", "governance", "storage", "streams")


def _collect(name: str) -> dict:
    out: dict = {}
    for group in _GROUPS:
        out.update(getattr(importlib.import_module(f"{__name__}.{group}"), name))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
