"""Named query plans: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.

Every query reads the driver tables (or data Spark derives from them) in full.  Doubles
are rounded on output (4 or 6 dp) so the DuckDB oracle can compare values; every computed
column is aliased to the same name on both sides.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every plan module so its queries register themselves."""
    from kestrel.plans import messages_plans, models_plans, orders_plans, prep_plans, retrieval_plans, vector_plans  # noqa: F401
