"""Registry of queries: each has a Spark builder ``fn(spark, sf_dir) -> DataFrame`` and,
when the result is SQL-expressible, a DuckDB oracle over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Query:
    name: str
    fn: Callable
    sql: str | Callable[[], str] | None
    ids: tuple = field(default_factory=tuple)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return self.sql() if callable(self.sql) else self.sql


REGISTRY: dict[str, Query] = {}


def register(name: str, sql=None, ids=()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(ids))
        return fn

    return deco


def load_all() -> dict[str, Query]:
    from . import (  # noqa: F401
        q_ensemble,
        q_features,
        q_flagship,
        q_logs,
        q_matrix,
        q_metrics,
        q_models,
        q_pseudo,
        q_sampling,
        q_search,
        q_streaming,
    )

    return REGISTRY
