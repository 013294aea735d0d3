"""Model evaluation as relational aggregation (E1-E13) and data diagnostics.

Binary operators take a scored table with a 0/1 ``label`` and a probability ``score``;
multiclass ones take ``true`` and ``pred`` integer columns.  Every metric is one or two
aggregations with partial (map-side) combine; nothing is collected to the driver and
no operator explodes rows by the threshold grid.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions import rules as R


def _pos(label: str) -> Column:
    return (F.col(label) == 1).cast("long")


def confusion_counts(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5,
                     by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn at ``score >= threshold`` (inclusive), optionally per group."""
    pred = (F.col(score) >= F.lit(threshold)).cast("long")
    y = _pos(label)
    return df.groupBy(*by).agg(
        F.sum(pred * y).alias("tp"),
        F.sum(pred * (1 - y)).alias("fp"),
        F.sum((1 - pred) * y).alias("fn"),
        F.sum((1 - pred) * (1 - y)).alias("tn"),
        F.count(F.lit(1)).alias("n"),
    )


def binary_metrics(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5,
                   by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; 0/0 counts as 0."""
    c = confusion_counts(df, label, score, threshold, by)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        *by,
        F.col("n"),
        R.safe_div(tp + tn, F.col("n")).alias("accuracy"),
        R.safe_div(tp, tp + fp).alias("precision"),
        R.safe_div(tp, tp + fn).alias("recall"),
        R.safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


AUC_BINS = 4096


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC with tied scores counting one half (the Mann-Whitney statistic).

    Rows are first reduced to distinct ``(by, score)`` with positive/negative counts.  The negatives below a score
    are those in the score bins below its own (at most AUC_BINS counts of a group) and those below it in its bin (a
    window over one bin), so no group's scores are ever sorted in one task.  Null when a group lacks a class.
    """
    y = _pos(label)
    bin_of = R.clamp(F.floor(F.col(score) * AUC_BINS), 0, AUC_BINS - 1)
    per_score = df.groupBy(*by, score).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")).withColumn("_bin", bin_of)
    below = Window.partitionBy(*by, "_bin").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    per_score = per_score.withColumn("_under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    bins = per_score.groupBy(*by, "_bin").agg(
        F.sum((2 * F.col("_under") + F.col("neg")).cast("double") * F.col("pos")).alias("_inside"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most AUC_BINS rows
    bins = bins.withColumn("_before", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    agg = bins.groupBy(*by).agg(
        F.sum(F.col("_inside") + 2.0 * F.col("_before").cast("double") * F.col("pos")).alias("_u2"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )
    auc = F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(None).cast("double")).otherwise(
        F.col("_u2") / (2.0 * F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))
    )
    return agg.select(*by, auc.alias("roc_auc"), "n_pos", "n_neg")


PACK_ROWS = 65_536  # rows whose scores a task packs at a time, and rows of a group to a bin


def _packed(batches, n: int, bins: int):
    """(group, label, score 0..n-1) rows to (s, group, bin, values, pos, neg): the different scores of some rows and how many of
    them are positive and negative."""
    def packed(held):
        table = pa.Table.from_batches(held).combine_chunks()
        group, y = np.asarray(table.column(0)), np.asarray(table.column(1))
        for s in range(n):
            score = np.asarray(table.column(2 + s))
            order = np.lexsort((score, group))
            g, v, p = group[order], score[order], y[order]
            first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | ((v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))))))
            size = np.diff(np.concatenate((first, [len(g)])))
            pos = np.add.reduceat(p, first)
            g, v = g[first], v[first]
            at = np.clip(np.floor(np.where(np.isnan(v), np.inf, v) * bins), 0, bins - 1).astype(np.int32)
            run = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (at[1:] != at[:-1]))))
            ends = pa.array(np.concatenate((run, [len(g)])), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (v, pos.astype(np.int32), (size - pos).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(run), s, np.int32)), pa.array(g[run]), pa.array(at[run]), *lists],
                                             names=["s", "g", "bin", "values", "pos", "neg"])

    held = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= PACK_ROWS:
            yield from packed(held)
            held = []
    if held:
        yield from packed(held)


def _bin_counts(table):
    """The packed scores of one bin to its part of the statistic, counted in whole numbers, and its positives and negatives."""
    value, pos, neg = (np.asarray(table.column(c).combine_chunks().flatten()) for c in ("values", "pos", "neg"))
    order = np.argsort(value, kind="stable")
    value, pos, neg = value[order], pos[order].astype(np.int64), neg[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) & ~(np.isnan(value[1:]) & np.isnan(value[:-1])))))
    pos, neg = np.add.reduceat(pos, first), np.add.reduceat(neg, first)
    inside = int(((2 * (np.cumsum(neg) - neg) + neg) * pos).sum())
    return pa.table({**{c: pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("s", "g", "bin")}, "_inside": pa.array([float(inside)]),
                     "pos": pa.array([int(pos.sum())]), "neg": pa.array([int(neg.sum())])})


def roc_auc_of_scores(df: DataFrame, label: str, scores: Sequence[Column], group: str, rows: int) -> DataFrame:
    """E2 of several scores of the same rows in each ``group`` (an int column): ``s`` (place in ``scores``), ``g``, ``roc_auc``.

    The same statistic as ``roc_auc`` (null scores stand lowest).  A task packs the scores of many rows as sorted lists by
    score bin, so a score is moved as a number in a list instead of a row; ``rows``, the rows of a group, says how
    many bins there are, and a bin of some PACK_ROWS scores is sorted at a time.
    """
    bins = min(AUC_BINS, max(1, -(-rows // PACK_ROWS)))
    flat = df.where(F.col(label).isNotNull()).select(
        F.col(group).cast("int").alias("g"), (F.col(label) == 1).cast("int").alias("y"),
        *[F.coalesce(s.cast("double"), F.lit(float("-inf"))).alias(f"s{i}") for i, s in enumerate(scores)])
    n = len(scores)
    packed = flat.mapInArrow(lambda it: _packed(it, n, bins), "s int, g int, bin int, values array<double>, pos array<int>, neg array<int>")
    counts = packed.groupBy("s", "g", "bin").applyInArrow(_bin_counts, "s int, g int, bin int, _inside double, pos long, neg long")
    before = Window.partitionBy("s", "g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most AUC_BINS rows
    counts = counts.withColumn("_before", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    u2 = F.sum(F.col("_inside") + 2.0 * F.col("_before").cast("double") * F.col("pos"))
    both = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return counts.groupBy("s", "g").agg(F.when(both > 0, u2 / (2.0 * both)).alias("roc_auc"))


def _sweep_bin(score: Column) -> Column:
    """How many grid thresholds t_i = (10 + 2i)/100 satisfy score >= t_i (0..41).

    A closed-form estimate corrected once in each direction by exact comparison with the
    grid value, so boundary scores land exactly as ``score >= t`` decides.
    """
    n = (R.SWEEP_HI - R.SWEEP_LO) // R.SWEEP_STEP + 1

    def t(i: Column) -> Column:
        return (F.lit(R.SWEEP_LO) + R.SWEEP_STEP * i).cast("double") / 100.0

    est = R.clamp(F.floor((score * 100 - R.SWEEP_LO) / R.SWEEP_STEP) + 1, 0, n)
    up = F.when((est < n) & (score >= t(est)), est + 1).otherwise(est)
    return F.when((up > 0) & (score < t(up - 1)), up - 1).otherwise(up).cast("int")


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """F1, recall and precision of class 1 at each of the 41 grid thresholds.

    Each row is binned once by how many thresholds it clears; the (<= 42 bins x groups)
    counts are then turned into suffix sums.  No per-threshold copy of the data.
    """
    spark = df.sparkSession
    n = (R.SWEEP_HI - R.SWEEP_LO) // R.SWEEP_STEP + 1
    y = _pos(label)
    counts = df.groupBy(*by, _sweep_bin(F.col(score)).alias("bin")).agg(
        F.sum(y).alias("pos"), F.count(F.lit(1)).alias("cnt")
    )
    if by:
        grid = counts.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("bin"))
        g = grid.join(counts, [*by, "bin"], "left")
    else:
        grid = spark.range(0, n + 1).select(F.col("id").cast("int").alias("bin"))
        g = grid.join(F.broadcast(counts), "bin", "left")  # at most n + 1 = 42 rows
    g = g.fillna(0, ["pos", "cnt"])
    w_all = Window.partitionBy(*by) if by else Window.partitionBy()
    w_suffix = w_all.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    g = g.select(
        *by, "bin",
        F.sum("pos").over(w_suffix).alias("tp"),
        F.sum("cnt").over(w_suffix).alias("pp"),
        F.sum("pos").over(w_all).alias("p"),
    ).where(F.col("bin") >= 1)
    tp, pp, p = F.col("tp"), F.col("pp"), F.col("p")
    return g.select(
        *by,
        F.round((F.lit(R.SWEEP_LO) + R.SWEEP_STEP * (F.col("bin") - 1)).cast("double") / 100.0, 2).alias("threshold"),
        R.safe_div(2 * tp, pp + p).alias("f1"),
        R.safe_div(tp, p).alias("recall"),
        R.safe_div(tp, pp).alias("precision"),
    )


def best_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The row with the highest F1; the lowest threshold wins ties."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(F.col("f1").desc(), F.col("threshold").asc())
    return sweep.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")


def recall_gain(sweep: DataFrame, default_threshold: float = 0.5) -> DataFrame:
    """E5: recall at the best-F1 threshold minus recall at the default threshold, 4 dp.

    Both rows come from the sweep (0.5 is a grid point), so this is one aggregate over it.
    """
    best = F.max_by(F.struct("threshold", "recall"), F.struct(F.col("f1"), -F.col("threshold")))
    dflt = F.max(F.when(F.col("threshold") == default_threshold, F.col("recall")))
    r = sweep.agg(best.alias("b"), dflt.alias("d"))
    return r.select(
        F.col("b.threshold").alias("best_threshold"),
        F.round("b.recall", 4).alias("best_recall"),
        F.round("d", 4).alias("default_recall"),
        F.round(F.round("b.recall", 4) - F.round("d", 4), 4).alias("recall_gain"),
    )


def subgroup_metrics(df: DataFrame, group_cols: Sequence[str], label: str = "label", score: str = "score",
                     threshold: float = 0.5) -> DataFrame:
    """N, recall and precision at ``threshold`` for every value of each group column.

    All dimensions are computed in one pass with grouping sets; the output is long form
    ``(dimension, group_value, n, recall, precision)``.
    """
    pred = (F.col(score) >= F.lit(threshold)).cast("long")
    y = _pos(label)
    base = df.select(*[F.col(c).cast("string").alias(c) for c in group_cols], pred.alias("_p"), y.alias("_y"))
    agg = base.groupingSets([[c] for c in group_cols], *group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_p") * F.col("_y")).alias("tp"),
        F.sum(F.col("_p")).alias("pp"),
        F.sum(F.col("_y")).alias("p"),
        *[F.grouping(c).alias(f"_g_{c}") for c in group_cols],
    )
    dim = None
    val = None
    for c in group_cols:
        is_c = F.col(f"_g_{c}") == 0
        dim = F.when(is_c, F.lit(c)) if dim is None else dim.when(is_c, F.lit(c))
        val = F.when(is_c, F.col(c)) if val is None else val.when(is_c, F.col(c))
    return agg.select(
        dim.alias("dimension"),
        val.alias("group_value"),
        F.col("n"),
        F.round(R.safe_div(F.col("tp"), F.col("p")), 4).alias("recall"),
        F.round(R.safe_div(F.col("tp"), F.col("pp")), 4).alias("precision"),
    )


def rate_overall(df: DataFrame, label: str = "returned") -> DataFrame:
    """row count and positive rate, 4 dp."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(F.col(label).cast("double")), 4).alias("return_rate"))


def rate_by_group(df: DataFrame, group_cols: Sequence[str], label: str = "returned") -> DataFrame:
    """positive rate per value of each group column, one pass via grouping sets."""
    base = df.select(*[F.col(c).cast("string").alias(c) for c in group_cols], F.col(label).cast("double").alias("_y"))
    agg = base.groupingSets([[c] for c in group_cols], *group_cols).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("rate"),
        *[F.grouping(c).alias(f"_g_{c}") for c in group_cols],
    )
    dim = val = None
    for c in group_cols:
        is_c = F.col(f"_g_{c}") == 0
        dim = F.when(is_c, F.lit(c)) if dim is None else dim.when(is_c, F.lit(c))
        val = F.when(is_c, F.col(c)) if val is None else val.when(is_c, F.col(c))
    return agg.select(dim.alias("dimension"), val.alias("group_value"), "n", F.round("rate", 4).alias("return_rate"))


def missing_rate_by_group(df: DataFrame, column: str = "rating_given", group: str = "payment_method") -> DataFrame:
    """null rate of ``column`` overall and per group, plus the max-min gap (MAR check)."""
    isnull = F.col(column).isNull().cast("long")
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(isnull).alias("n_missing"))
    w = Window.partitionBy()  # over the per-group rows only (one per group value)
    rate = F.col("n_missing") / F.col("n")
    return per.select(
        group, "n",
        F.round(rate, 4).alias("missing_rate"),
        F.round(F.sum("n_missing").over(w) / F.sum("n").over(w), 4).alias("overall_missing_rate"),
        F.round(F.max(rate).over(w) - F.min(rate).over(w), 4).alias("max_min_gap"),
    )
