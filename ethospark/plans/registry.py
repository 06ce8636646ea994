"""Registry of queries: name -> (Spark function, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register fn(spark, sf_dir) under name, with the SQL that must give the same rows."""

    def put(fn):
        if name in _REGISTRY:
            raise ValueError(f"{name} is registered twice")
        _REGISTRY[name] = (fn, sql)
        return fn

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: fn for k, (fn, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _REGISTRY.items() if sql}
