"""Registered queries of the library: name -> Spark query, and name -> DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with the SQL of its rows if SQL can express them."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


for _name in ("urls", "pages", "scores", "markup", "sites", "reports", "evaluation"):
    import_module(f"sitelens.plans.{_name}")
