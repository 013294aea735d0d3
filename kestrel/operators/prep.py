"""Preparation operators (P1-P11): projection, stratified splits, folds, imputation,
scaling, one-hot encoding, class weights.

Fitted statistics (medians, modes, means, weights) are computed on the rows the caller
passes (the train split), returned as small frames or scalars, and applied to any frame:
fitting on train and applying to test is what keeps the preparation leak-free.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.hashing import hash32


MAX_CLASSES = 10_000  # the class list is held on the driver; more labels than this are an error
BOUNDARY_ROWS = 10_000  # rows around a cut that are looked at one by one, for each class or column


def _quotas(counts: dict, n_test: int) -> dict:
    """Test rows of each class: floor share plus largest remainder (ties to the lower label)."""
    total = sum(counts.values())
    share = {c: divmod(n_test * n, total) for c, n in counts.items()}
    left = n_test - sum(base for base, _ in share.values())
    order = sorted(counts, key=lambda c: (-share[c][1], (c is not None, c)))
    return {c: share[c][0] + (i < left) for i, c in enumerate(order)}


def _is(label: str, value) -> Column:
    return F.col(label).isNull() if value is None else F.col(label) == F.lit(value)


def _cuts(rows: DataFrame, label: str, id_col: str, quotas: dict) -> dict:
    """The last ``(h, id)`` of each class's first ``quota`` rows, found without sorting the table.

    Rows are counted by class and leading bits of the hash; only the bucket in which a class's quota ends is
    looked into, with more bits as long as it is large, and at last row by row.  Each pass is one aggregation of
    narrow rows; what comes to the driver is bounded by classes x 4096 counts and classes x BOUNDARY_ROWS rows.
    """
    todo = {c: (0, q) for c, q in quotas.items() if q > 0}  # class: leading bits so far, rows still to take
    bits, cuts = 0, {}
    sizes = dict.fromkeys(todo, BOUNDARY_ROWS + 1)
    while todo and bits < 32 and max(sizes[c] for c in todo) > BOUNDARY_ROWS:
        step = min(12, 32 - bits)
        inside = None
        for c, (lead, _) in todo.items():
            cond = _is(label, c) & (F.shiftright("h", 32 - bits) == lead) if bits else _is(label, c)
            inside = cond if inside is None else inside | cond
        bits += step
        found: dict = {}
        for r in rows.where(inside).groupBy(label, F.shiftright("h", 32 - bits).alias("lead")).count().collect():
            found.setdefault(r[0], []).append((r[1], r[2]))
        for c, (_, need) in list(todo.items()):
            for lead, n in sorted(found[c]):
                if need <= n:
                    todo[c], sizes[c] = (lead, need), n
                    break
                need -= n
    for c, (lead, need) in todo.items():
        # the bucket is small by now (or all of one hash), so taking its first rows is a bounded top-k
        first = rows.where(_is(label, c) & (F.shiftright("h", 32 - bits) == lead)).select("h", id_col).orderBy("h", id_col).limit(need)
        cuts[c] = tuple(first.agg(F.max(F.struct("h", id_col))).first()[0])
    return cuts


def stratified_split(
    df: DataFrame, label: str, id_col: str, test_size: float | int = 0.2, seed: int = 42,
    min_test: int | None = None, names: tuple[str, str] = ("train", "test"), tag: str = "split",
) -> DataFrame:
    """Add a ``split`` column with an exact stratified test share.

    ``test_size`` is a fraction (test rows = ceil(fraction * n)) or an absolute row count.  The rows of a class
    that are first by a seeded hash of the (unique) id go to test.  The cut of each class is found by counting
    (``_cuts``), so the table itself is neither moved nor written: the result is a projection of ``df``.
    ``min_test`` raises if the test share would be smaller (the reference's size assertion).
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()}
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label}")
    n = sum(counts.values())
    n_test = math.ceil(round(test_size * n, 9)) if isinstance(test_size, float) else min(int(test_size), n)
    if min_test is not None and n_test < min_test:
        raise ValueError(f"split too small: {n_test} < {min_test}")
    if not counts:
        return df.withColumn("split", F.lit(names[0]))
    h = hash32(id_col, tag, seed)
    cuts = _cuts(df.select(label, id_col, h.alias("h")), label, id_col, _quotas(counts, n_test))
    test = F.lit(False)
    for c, (cut, last) in cuts.items():
        test = F.when(_is(label, c), (h < cut) | ((h == cut) & (F.col(id_col) <= F.lit(last)))).otherwise(test)
    return df.withColumn("split", F.when(test, F.lit(names[1])).otherwise(F.lit(names[0])))


def kfold_assign(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42,
                 rows_per_bucket: int = 50_000) -> DataFrame:
    """P10: stratified, shuffled fold numbers 0..k-1 (position within class mod k).

    A row's position is the number of rows in the buckets before its own (a bucket is a class and the leading
    bits of the hash; at most classes x 2**20 counts) plus its rank in the bucket, so one shuffle of the given
    rows by bucket does and a class of most rows is spread over its buckets.
    """
    n = df.count()
    bits = min(20, max(0, math.ceil(math.log2(max(1, n / rows_per_bucket)))))
    rows = df.withColumns({"_h": hash32(id_col, "fold", seed)}).withColumn("_lead", F.shiftright("_h", 32 - bits) if bits else F.lit(0).cast("long"))
    counts = rows.groupBy(label, "_lead").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col(label).alias("_label"), F.col("_lead").alias("_l"), F.coalesce(F.sum("_n").over(
        Window.partitionBy(label).orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(label, "_lead").orderBy("_h", id_col)) - 1
    ranked = rows.withColumn("_rank", rank)
    if bits <= 12:
        before = F.broadcast(before)  # classes x 4096 rows at most
    out = ranked.join(before, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_lead") == F.col("_l")))
    return out.withColumn("fold", F.pmod(F.col("_before") + F.col("_rank"), F.lit(k)).cast("int")).select(*df.columns, "fold")


def _halfway(n: int) -> tuple[int, int]:
    return (n - 1) // 2, n // 2


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """P4 fit: the interpolated median of each column, ignoring nulls.

    Passes over the table narrow all columns' ranges at once: quantile sketches just below and above the middle
    bound the median, the rows below are counted exactly, until at most BOUNDARY_ROWS rows of a column are
    left in its range, whose distinct values and counts decide.  Where a pass gets no further (the middle lies
    between two values that many rows share), the rows at the range's two ends are counted: a middle row is one of
    them, next to one, or in the range without them.  No row is copied and nothing is sorted.
    """
    value = {c: F.col(c).cast("double") for c in cols}
    row = df.agg(*[e for i, c in enumerate(cols) for e in (F.count(value[c]).alias(f"n{i}"), F.min(value[c]).alias(f"lo{i}"), F.max(value[c]).alias(f"hi{i}"))]).first()
    # column: (low, high, rows below low, rows in the range, rows in all)
    state = {c: (row[f"lo{i}"], row[f"hi{i}"], 0, row[f"n{i}"], row[f"n{i}"]) for i, c in enumerate(cols) if row[f"n{i}"]}

    middles: dict = {}  # columns decided by the ends of their range

    def large(c):
        lo, hi, _, inside, _ = state[c]
        return inside > BOUNDARY_ROWS and lo < hi

    while any(map(large, state)):
        todo = [c for c in state if large(c)]
        asked = []
        for i, c in enumerate(todo):
            lo, hi, below, inside, n = state[c]
            a, b = _halfway(n)
            shares = [max(0.0, (a - below) / inside - 0.002), min(1.0, (b - below + 1) / inside + 0.002)]
            asked.append(F.percentile_approx(F.when(value[c].between(lo, hi), value[c]), shares, 2000).alias(f"q{i}"))
        bounds = df.agg(*asked).first()
        counts = []
        for i, c in enumerate(todo):
            lo, hi = bounds[f"q{i}"]
            counts += [F.count(F.when(value[c] < lo, 1)).alias(f"b{i}"), F.count(F.when(value[c].between(lo, hi), 1)).alias(f"i{i}")]
        row = df.agg(*counts).first()
        tied = []
        for i, c in enumerate(todo):
            (lo, hi), (_, _, _, before, n) = bounds[f"q{i}"], state[c]
            below, inside = row[f"b{i}"], row[f"i{i}"]
            a, b = _halfway(n)
            if not below <= a <= b < below + inside or inside == before:  # a sketch that missed, or no progress
                tied.append(c)
            else:
                state[c] = (lo, hi, below, inside, n)
        if not tied:
            continue
        ends = []
        for i, c in enumerate(tied):
            lo, hi, v = *state[c][:2], value[c]
            within = (v > lo) & (v < hi)
            ends += [F.count(F.when(v == lo, 1)).alias(f"l{i}"), F.count(F.when(v == hi, 1)).alias(f"h{i}"),
                     F.min(F.when(within, v)).alias(f"a{i}"), F.max(F.when(within, v)).alias(f"z{i}")]
        row = df.agg(*ends).first()
        for i, c in enumerate(tied):
            lo, hi, below, inside, n = state[c]
            first, last = below + row[f"l{i}"], below + inside - row[f"h{i}"]  # ranks of the rows between the ends
            a, b = _halfway(n)
            if first <= a and b < last:
                state[c] = (row[f"a{i}"], row[f"z{i}"], first, last - first, n)
            else:  # b is a or the one after it, so one between the ends is next to an end
                middles[c] = (lo if a < first else hi if a >= last else row[f"z{i}"], lo if b < first else hi if b >= last else row[f"a{i}"])
                del state[c]
    # a range of one value is decided; of the others, only the few rows inside are unpivoted
    middles |= {c: (lo, lo) for c, (lo, hi, _, _, _) in state.items() if lo == hi}
    state = {c: s for c, s in state.items() if c not in middles}
    inside = [F.struct(F.lit(c).alias("column"), F.when(value[c].between(lo, hi), value[c]).alias("value"))
              for c, (lo, hi, _, _, _) in state.items()]
    out = dict.fromkeys(cols) | {c: (a + b) / 2 for c, (a, b) in middles.items()}
    if not inside:
        return out
    some = reduce(Column.__or__, [value[c].between(lo, hi) for c, (lo, hi, _, _, _) in state.items()])
    near = df.where(some).select(F.explode(F.filter(F.array(*inside), lambda x: x["value"].isNotNull())).alias("x"))
    values: dict = {}
    for r in near.groupBy("x.column", "x.value").count().collect():
        values.setdefault(r[0], []).append((r[1], r[2]))
    for c, (_, _, below, _, n) in state.items():
        middle = []
        for rank in _halfway(n):
            at = below
            for v, k in sorted(values[c]):
                at += k
                if rank < at:
                    middle.append(v)
                    break
        out[c] = (middle[0] + middle[1]) / 2
    return out


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P5 fit: most frequent non-null value per column, the lowest value on ties."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value").where(F.col("value").isNotNull())
    cnt = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return cnt.groupBy("column").agg(F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode"))


def _as_dict(stats: DataFrame, key: str, val: str) -> dict:
    """Fitted statistics are one row per feature column: small by construction."""
    return {r[key]: r[val] for r in stats.collect()}


def impute(df: DataFrame, fill: dict) -> DataFrame:
    """P4/P5 apply: replace nulls with the fitted value per column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in fill.items()})


def scaling_stats(df: DataFrame, cols: Sequence[str]) -> dict:
    """P6 fit: mean and population std per column; std 0 is replaced by 1."""
    row = df.agg(*[e for c in cols for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] if row[f"s_{c}"] else 1.0) for c in cols}


def standard_scale(df: DataFrame, stats: dict) -> DataFrame:
    """P6 apply: (x - mean) / std."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def one_hot_model(train: DataFrame, cols: Sequence[str]):
    """P7 fit: alphabetical categories; unseen or null values encode as all zeros.

    StringIndexer(alphabetAsc, handleInvalid='keep') puts unknowns in the last index, and
    OneHotEncoder(dropLast=True) drops exactly that slot: a vector has one slot for each train category.
    """
    stages = []
    for c in cols:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetAsc",
                                    handleInvalid="keep"))
    stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in cols], outputCols=[f"{c}__oh" for c in cols],
                                dropLast=True))
    return Pipeline(stages=stages).fit(train)


def one_hot_names(model, cols: Sequence[str]) -> list[str]:
    names = []
    for c, stage in zip(cols, model.stages[: len(cols)]):
        names.extend(f"{c}_{lab}" for lab in stage.labels)
    return names


def one_hot_columns(model, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P7 apply in relational form: one double column per category, named ``<col>_<value>``."""
    out = model.transform(df)
    for c, stage in zip(cols, model.stages[: len(cols)]):
        arr = vector_to_array(F.col(f"{c}__oh"))
        out = out.withColumns({f"{c}_{lab}": arr[i] for i, lab in enumerate(stage.labels)})
    return out.drop(*[f"{c}__idx" for c in cols], *[f"{c}__oh" for c in cols])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c), one row per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()  # over the class rows only
    return c.select(label, "n_c", (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, weights: DataFrame, out: str = "weight") -> DataFrame:
    """Attach the weight column; ``weights`` has one row per class (broadcast bounded by classes)."""
    return df.join(F.broadcast(weights.select(label, F.col("weight").alias(out))), label, "left")
