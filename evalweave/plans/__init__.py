"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

from evalweave.plans.registry import ORACLE, QUERIES

_MODULES = ("extraction", "verification", "preparation", "shaping", "noising", "scoring")


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"evalweave.plans.{m}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracle_sql():
    _load()
    return dict(ORACLE)
