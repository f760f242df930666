"""All queries of the document engine, with their SQL twins."""

from __future__ import annotations

import importlib

MODULES: list[str] = ["geometry", "documents", "web", "parts", "files"]


def _all():
    for name in MODULES:
        yield from importlib.import_module(f"quire.plans.{name}").QUERIES


def queries():
    return {name: fn for name, fn, _ in _all()}


def oracle_sql():
    return {name: sql for name, _, sql in _all() if sql}
