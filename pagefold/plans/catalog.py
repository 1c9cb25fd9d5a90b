"""Registry of named queries: Spark builder + optional DuckDB oracle SQL.

Each query reads the driver tables under ``sf_dir`` (or data Spark derives
from them) and returns a lazy DataFrame.  ``oracle`` is an independent SQL
formulation run by DuckDB over the same parquet files; queries without one
are checked on row counts plus golden unit tests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every plan module so their queries register."""
    from pagefold.plans import (  # noqa: F401
        q_links, q_html, q_items, q_extract, q_compliance, q_telemetry, q_ops, q_retrieval,
        q_dom, q_containers, q_recorded, q_plans, q_plan_run, q_consent, q_streaming, q_sources,
    )
    return REGISTRY
