"""
independently written DuckDB oracle (or none, for learned models).

Query modules call :func:`register`; ``__spark_entry__`` exposes :func:`queries` and
:func:`oracle_sql`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with an
    optional oracle SQL text."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # importing the modules registers their queries
    from tiercat.plans import (q_prepare, q_profile, q_text, q_metrics,  # noqa: F401
                               q_predict, q_keywords, q_features, q_train)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)
