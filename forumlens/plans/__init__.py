"""Registered queries."""

from __future__ import annotations

import importlib

from forumlens.plans.registry import CHECKS, QUERIES

MODULES = ["records", "texts", "terms", "models", "classifiers", "sinks"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"forumlens.plans.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_checks():
    _load()
    return dict(CHECKS)
