"""Scans of the driver tables.

Each scan names the columns it needs so the parquet reader prunes everything else
(``ReadSchema`` in the plan shows only these columns); filters written afterwards are
pushed into the scan by Catalyst.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over the session's cores where the table is so small (``SPREAD_BYTES`` by the planner's estimate) that it may lie
    in a row group or two; a larger table is read as it lies, since a shuffle of it would cost more than it brings."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df
