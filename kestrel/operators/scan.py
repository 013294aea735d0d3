"""Running (prefix) aggregates per key that stay balanced when one key is huge.

``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task, so a key
holding a third of the table becomes a third of the job in one task.  ``running_scan``
computes the same values with a distributed prefix sum:

1. ``repartitionByRange(n, key, order)`` with an explicit ``n``: the range bounds split a
   hot key over many partitions; ``spark_partition_id()`` right after the exchange is
   the block number.
2. A window over ``(block, key)`` computes the running values inside each block.  The
   result is written once as Parquet in ``spark.checkpoint.dir``: the range
   sampler is seeded per plan, so two branches that each re-ran the exchange could
   disagree on block bounds; reading one written copy keeps them consistent, cuts the
   lineage (a lost executor re-reads the files, it does not re-sample) and lets each
   reader take its own columns only.
3. Only the first and last key of a block can continue across blocks.  Their per-block
   totals (at most ``2n`` rows) are turned into carry-in offsets with a window over
   ``block``; the offsets (at most ``n`` rows, one continuing key per block) are
   broadcast back.  Both broadcast sides are bounded by the partition count, not by
   the data.

With no key the scan is global (a running total over the whole ordered table), which
ROC-AUC and global row positions need.

Aggregates: ``("count", None)``, ``("sum", col)``, ``("last", col)`` (last non-null
value), ``("first", col)`` (value on the key's first row) and ``("first_nonnull", col)``.  Each is exclusive of the
current row unless ``inclusive=True`` is given as a third element.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.session import stored

_PID = "_scan_pid"
_CONST = "_scan_key"


def _num_blocks(df: DataFrame, num_blocks: int | None) -> int:
    if num_blocks:
        return int(num_blocks)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _key_struct(keys: Sequence[str]) -> Column:
    # always a struct: struct ordering puts null fields first (as the range partitioning
    # does), whereas min/max over a bare column would skip null keys
    return F.struct(*[F.col(k) for k in keys])


def running_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: Mapping[str, tuple],
    num_blocks: int | None = None,
) -> DataFrame:
    """Add one column per entry of ``aggs`` (output name -> (kind, column[, inclusive])).

    ``order`` must make the order total within a key (end it with a unique column);
    otherwise ties are broken arbitrarily, as with any window.
    """
    keys = list(keys)
    order = list(order)
    if not keys:
        df = df.withColumn(_CONST, F.lit(0))
        keys = [_CONST]
    n = _num_blocks(df, num_blocks)

    ranged = df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in keys + order]).withColumn(
        _PID, F.spark_partition_id()
    )

    # -- 2. running values inside each (block, key) ------------------------------------
    w_local = Window.partitionBy(_PID, *keys).orderBy(*order)
    local = ranged
    specs = {}
    for name, spec in aggs.items():
        kind, col = spec[0], spec[1]
        inclusive = bool(spec[2]) if len(spec) > 2 else False
        specs[name] = (kind, col, inclusive)
        frame = w_local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        if kind == "count":
            local = local.withColumn(f"_l_{name}", F.count(F.lit(1)).over(frame))
        elif kind == "sum":
            local = local.withColumn(f"_l_{name}", F.coalesce(F.sum(col).over(frame), F.lit(0)))
        elif kind == "last":
            local = local.withColumn(f"_l_{name}", F.last(col, ignorenulls=True).over(frame))
        elif kind == "first":
            local = local.withColumn(f"_l_{name}", F.first(col).over(frame))
        elif kind == "first_nonnull":
            local = local.withColumn(f"_l_{name}", F.first(col, ignorenulls=True).over(frame))
        else:
            raise ValueError(f"unknown scan aggregate {kind!r}")

    local = stored(local, "scan")

    # -- 3. carry-in offsets for keys that continue across blocks -----------------------
    kstruct = _key_struct(keys)
    bounds = local.groupBy(_PID).agg(F.min(kstruct).alias("_lo"), F.max(kstruct).alias("_hi"))
    # null-safe: a null key is one group for the window, so it must match here too
    edge = local.join(F.broadcast(bounds), _PID).where(kstruct.eqNullSafe(F.col("_lo")) | kstruct.eqNullSafe(F.col("_hi")))
    ostruct = F.struct(*[F.col(c) for c in order])
    tot_exprs = [F.count(F.lit(1)).alias("_t_count")]
    for name, (kind, col, _) in specs.items():
        if kind == "sum":
            tot_exprs.append(F.coalesce(F.sum(col), F.lit(0)).alias(f"_t_{name}"))
        elif kind == "last":
            tot_exprs.append(F.max_by(F.col(col), F.when(F.col(col).isNotNull(), ostruct)).alias(f"_t_{name}"))
        elif kind == "first":
            tot_exprs.append(F.min_by(F.col(col), ostruct).alias(f"_t_{name}"))
        elif kind == "first_nonnull":
            tot_exprs.append(F.min_by(F.col(col), F.when(F.col(col).isNotNull(), ostruct)).alias(f"_t_{name}"))
    totals = edge.groupBy(_PID, *keys).agg(*tot_exprs)
    w_blk = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    off_exprs = [F.sum("_t_count").over(w_blk).alias("_o_rows")]
    for name, (kind, col, _) in specs.items():
        if kind == "count":
            off_exprs.append(F.sum("_t_count").over(w_blk).alias(f"_o_{name}"))
        elif kind == "sum":
            off_exprs.append(F.sum(f"_t_{name}").over(w_blk).alias(f"_o_{name}"))
        elif kind == "last":
            off_exprs.append(F.last(f"_t_{name}", ignorenulls=True).over(w_blk).alias(f"_o_{name}"))
        elif kind == "first":
            off_exprs.append(F.first(f"_t_{name}").over(w_blk).alias(f"_o_{name}"))
        elif kind == "first_nonnull":
            off_exprs.append(F.first(f"_t_{name}", ignorenulls=True).over(w_blk).alias(f"_o_{name}"))
    offsets = totals.select(_PID, *keys, *off_exprs).where(F.col("_o_rows") > 0)

    # -- 4. combine ---------------------------------------------------------------------
    offsets = offsets.select(F.col(_PID).alias("_o_pid"), *[F.col(k).alias(f"_ok_{k}") for k in keys],
                             *[c for c in offsets.columns if c.startswith("_o_")])
    cond = [F.col(_PID) == F.col("_o_pid")] + [F.col(k).eqNullSafe(F.col(f"_ok_{k}")) for k in keys]
    out = local.join(F.broadcast(offsets), cond, "left")
    final = []
    for name, (kind, col, inclusive) in specs.items():
        lo, off = F.col(f"_l_{name}"), F.col(f"_o_{name}")
        if kind in ("count", "sum"):
            final.append((lo + F.coalesce(off, F.lit(0))).alias(name))
        elif kind == "last":
            final.append(F.coalesce(lo, off).alias(name))
        elif kind == "first_nonnull":
            final.append(F.coalesce(off, lo).alias(name))
        else:  # first: when an earlier block holds the key, its first row is there
            final.append(F.when(F.col("_o_rows").isNotNull(), off).otherwise(lo).alias(name))
    base_cols = [f"`{c}`" for c in df.columns if c != _CONST]
    return out.select(*base_cols, *final)
