"""Connected components by alternating large-star and small-star rounds over an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.shared import written

SALT = 8


def _attach(edges: DataFrame, lows: DataFrame) -> DataFrame:
    """Edges with the smallest neighbour of ``u``; a node with many edges is spread over ``SALT`` keys."""
    left = edges.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALT)))
    right = lows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.join(right, ["u", "salt"]).drop("salt")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lows = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return _attach(both, lows).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    lows = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = _attach(edges, lows).filter("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(lows.select("u", F.col("low").alias("v"))).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` edges with u > v to ``(node, component)``: v is the smallest node reachable from u.

    Nodes that are smallest themselves do not appear.  Every round is written to the shared folder.
    """
    now = written(edges.select("u", "v").filter("u > v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = written(small_star(large_star(now).distinct()), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
