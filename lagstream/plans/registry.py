"""Queries of the time-series operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package with QUERIES (name to function of spark and sf_dir) and SQL (name to text).
MODULES: tuple[str, ...] = ("series", "models", "algebra")


def _gather(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"lagstream.plans.{module}"), name, {})
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
