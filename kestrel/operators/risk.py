"""Risk bucketing of a probability column (B1, B2)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.rules import HIGH_BUCKET_MARGIN


def risk_bucket_col(p: Column, t_star: Column) -> Column:
    """Low if p < t, High if p >= t + 0.15, Medium otherwise; decided on the unrounded p."""
    return F.when(p < t_star, F.lit("Low")).when(p >= t_star + HIGH_BUCKET_MARGIN, F.lit("High")).otherwise(F.lit("Medium"))


def risk_bucket(df: DataFrame, prob: str, t_star: float | Column) -> DataFrame:
    """B1: the three-way bucket plus rounded probability and cut points.

    ``t_star`` is a number or a column (e.g. from a broadcast one-row model-metadata
    frame joined in by the caller).
    """
    t = t_star if isinstance(t_star, Column) else F.lit(float(t_star))
    return df.withColumns({
        "return_probability": F.round(F.col(prob), 4),
        "risk_bucket": risk_bucket_col(F.col(prob), t),
        "t_star": t,
        "low_below": F.round(t, 4),
        "high_at_or_above": F.round(t + HIGH_BUCKET_MARGIN, 4),
    })


def risk_flag(df: DataFrame, prob: str, t_star: float | Column, out: str = "risk_flag") -> DataFrame:
    """B2: HIGH when p >= t, else LOW."""
    t = t_star if isinstance(t_star, Column) else F.lit(float(t_star))
    return df.withColumn(out, F.when(F.col(prob) >= t, F.lit("HIGH")).otherwise(F.lit("LOW")))
