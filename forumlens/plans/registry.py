"""Named queries over the given tables, each with its SQL check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(*covers: str, sql: str | None = None):
    """Register a query under its function name; `covers` are inventory ids."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        COVERS[fn.__name__] = covers
        if sql is not None:
            CHECKS[fn.__name__] = sql
        return fn

    return register
