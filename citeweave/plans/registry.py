"""Query catalogue: every registered query is a function ``(spark, sf_dir) -> DataFrame``
over the driver's tables, optionally paired with a DuckDB oracle SQL string."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    ops: str  # survey operator ids covered


REGISTRY: dict[str, Query] = {}


def register(name: str, ops: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ops)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from citeweave.plans import q_core, q_embed, q_graph, q_text_sets, q_vectors  # noqa: F401
    return REGISTRY
