"""Seeded, engine-independent pseudo-random numbers as column expressions.

``uniform(key, tag)`` is the first 32 bits of md5("<key>|<tag>|<seed>") scaled to [0, 1).
It is a pure function of the row, so it is reproducible across runs, partitionings and
engines (DuckDB computes the same value), unlike ``rand()``.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
TWO_POW_32 = 4294967296.0


def hash32(key: Column | str, tag: str, seed: int = SEED) -> Column:
    """The 32 bits behind ``uniform`` as a long; the order is the same."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{tag}|{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def uniform(key: Column | str, tag: str, seed: int = SEED) -> Column:
    return hash32(key, tag, seed).cast("double") / F.lit(TWO_POW_32)


def uniform_sql(key_sql: str, tag: str, seed: int = SEED) -> str:
    """The same number in DuckDB SQL (used by the oracle)."""
    return (
        f"(('0x' || substr(md5(CAST({key_sql} AS VARCHAR) || '|{tag}|{seed}'), 1, 8))::BIGINT"
        f" / {TWO_POW_32})"
    )
