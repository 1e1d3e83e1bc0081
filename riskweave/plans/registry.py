"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a ``(spark, sf_dir) -> DataFrame`` builder with its oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn

    return deco


def load_all() -> dict[str, Query]:
    """Import every query module (registration happens at import)."""
    from . import (q_dashboard, q_eval, q_explain, q_features, q_monitor, q_records, q_state,  # noqa: F401
                   q_streaming, q_timeseries, q_training)

    return REGISTRY
