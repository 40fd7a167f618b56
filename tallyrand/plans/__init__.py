"""Queries over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("snapshots", "metrics", "audits", "quality", "timelines", "worlds", "records", "given", "release")


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").ORACLE.items()}
