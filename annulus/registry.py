"""Queries over the provided tables, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PLANS = ("detection", "rings", "joins", "masks", "preparation", "matching", "contours", "fusion", "exports", "evaluation", "polygons", "shapes")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame under its own name, with DuckDB SQL for the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load() -> None:
    for name in PLANS:
        import_module(f"annulus.plans.{name}")


load()
