"""Multiclass evaluation (E9-E13) over (true, pred) integer columns.

The dense confusion matrix has classes x classes cells (a fixed, small grid built from a
range, not from the data); every count is one partial aggregation over the predictions.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(pred: DataFrame, true: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Share of rows with true == pred."""
    return pred.agg(F.count(F.lit(1)).alias("n"),
                    F.avg((F.col(true) == F.col(predicted)).cast("double")).alias("accuracy"))


def confusion_long(pred: DataFrame, n_classes: int, true: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """(true, pred, n) for every cell of the n x n grid, zero cells included."""
    spark = pred.sparkSession
    inside = F.col(true).between(0, n_classes - 1) & F.col(predicted).between(0, n_classes - 1)
    known = F.when(inside, F.col(true)).otherwise(F.raise_error(F.lit("a label outside the classes")).cast("int"))
    pred = pred.withColumn(true, known)  # an unknown label is an error, not a row left out
    counts = pred.groupBy(F.col(true).cast("int").alias("y_true"), F.col(predicted).cast("int").alias("y_pred")) \
        .agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(n_classes * n_classes).select((F.col("id") / n_classes).cast("int").alias("y_true"),
                                                     (F.col("id") % n_classes).cast("int").alias("y_pred"))
    return grid.join(counts, ["y_true", "y_pred"], "left").fillna(0, ["n"])


def confusion_wide(cm: DataFrame, class_names: Sequence[str]) -> DataFrame:
    """E10 wide form (rows true, columns predicted), first column the class name (S3 shape)."""
    names = F.element_at(F.array(*[F.lit(n) for n in class_names]), F.col("y_true") + 1)
    wide = cm.groupBy("y_true").pivot("y_pred", list(range(len(class_names)))).agg(F.sum("n"))
    for i, n in enumerate(class_names):
        wide = wide.withColumnRenamed(str(i), n)
    return wide.select(names.alias("class"), *class_names, "y_true").orderBy("y_true").drop("y_true")


def per_class(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0/0 = 0; 4 dp."""
    rows = cm.groupBy(F.col("y_true").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    cols = cm.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    m = rows.join(cols, "label")
    div = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    tp, sup, prd = F.col("tp"), F.col("support"), F.col("predicted")
    return m.select("label", F.col("support").cast("long").alias("support"),
                    F.round(div(tp, prd), 4).alias("precision"), F.round(div(tp, sup), 4).alias("recall"),
                    F.round(div(2.0 * tp, prd + sup), 4).alias("f1"))


def top_confused(cm: DataFrame, class_names: Sequence[str], k: int = 5) -> DataFrame:
    """The k largest off-diagonal cells; ties in row-major (true, pred) order."""
    names = F.array(*[F.lit(n) for n in class_names])
    off = cm.where(F.col("y_true") != F.col("y_pred"))
    return off.orderBy(F.col("n").desc(), "y_true", "y_pred").limit(k).select(
        "y_true", "y_pred", F.element_at(names, F.col("y_true") + 1).alias("true_class"),
        F.element_at(names, F.col("y_pred") + 1).alias("predicted_class"), "n")


def first_per_class(df: DataFrame, label: str, order: str, class_names: Sequence[str]) -> DataFrame:
    """The first row (in ``order``) of each class, named ``NN_<class>.png``.

    A min per class: partial aggregation, so a class holding most rows costs nothing extra.
    """
    names = F.array(*[F.lit(n) for n in class_names])
    first = df.groupBy(label).agg(F.min(order).alias(order))
    return first.select(label, order, F.format_string("%02d_%s.png", F.col(label),
                                                       F.element_at(names, F.col(label) + 1)).alias("file_name"))
