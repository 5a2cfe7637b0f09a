"""The registered queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Modules of this package that hold queries.
MODULES = ("catalogue", "identification", "naming", "library")


def query(sql: str | None) -> Callable:
    """Register a query under its function's name, with its SQL; None where SQL can't express it and a test has a brute-force version."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name, in the order of their modules."""
    for name in MODULES:
        importlib.import_module(f"lectern.plans.{name}")
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    queries()
    return dict(ORACLES)
