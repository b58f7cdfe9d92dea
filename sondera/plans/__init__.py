"""Registered queries of the core and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from sondera.plans import registry


def _load() -> None:
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(registry.SQL)
