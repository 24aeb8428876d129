"""Query catalog: every operator as ``(spark, sf_dir) -> DataFrame`` plus, where
the operator is SQL-expressible, the DuckDB oracle text over the same tables.

Modules register their queries with ``@register(key, sql)``; importing
``ordersight.plans.queries`` fills the catalog.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key!r}")
        REGISTRY[key] = (fn, sql)
        return fn
    return deco


def all_queries() -> dict[str, QueryFn]:
    import ordersight.plans.queries  # noqa: F401  (fills REGISTRY)
    return {k: v[0] for k, v in REGISTRY.items()}


def all_oracles() -> dict[str, str]:
    import ordersight.plans.queries  # noqa: F401
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}
