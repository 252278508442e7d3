"""Registry of the library's queries over the driver tables.

Each entry is ``name -> (spark, sf_dir) -> DataFrame`` and, where the
result can be written in SQL, ``name -> SQL`` for the DuckDB oracle.
Queries and their SQL twins live side by side in the ``q_*`` modules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def load_all() -> None:
    # Importing the modules fills the registry.
    from . import q_explore, q_model, q_names, q_prepare, q_profile, q_sources, q_tests  # noqa: F401
