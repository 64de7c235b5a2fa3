"""Registered queries: name -> (spark builder, DuckDB oracle or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver's parquet tables (or data Spark derives from them). Output columns are
scalars with names shared by the oracle text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None, doc: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle, doc or (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from quarry.plans import queries_files, queries_profile  # noqa: F401
    from quarry.plans import queries_report, queries_vectors, queries_stream  # noqa: F401
    return REGISTRY
