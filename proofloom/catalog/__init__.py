"""Queries over the given tables, one per operator, with SQL twins."""

from __future__ import annotations

from importlib import import_module

from proofloom.catalog.registry import ORACLE, QUERIES

_MODULES = ("text", "consistency", "xref", "ingest", "reports", "usage", "structure", "formatting", "streams")


def _load() -> None:
    for name in _MODULES:
        import_module(f"proofloom.catalog.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLE)
