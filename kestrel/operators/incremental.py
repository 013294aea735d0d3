"""Prefix aggregates over a table that arrives in batches: each batch reads its own rows and the carries of their keys.

After a batch, every key that it touched has one *carry*: for each aggregate the value over all rows of the key so far,
and the order of its last row.  The next batch takes the carries of its keys as a first row of each key, before all
new ones, and runs ``running_scan`` over both; so a key with a third of the rows is split over tasks as it is there, and
the carries meet no join with the rows themselves.

State below ``path``: a folder of carries for each batch, holding the batch's keys only, and a manifest whose line for the
batch is written last.  A run that stops before that line leaves a folder that nobody reads, and is simply run again;
so is the newest batch.  The newest carry of a key is the one of its highest batch; ``compact`` writes them as one folder.

Batches come in the order of the scan within each key: a row that orders before one of an earlier batch would change rows
that were already given out, so such a batch raises ``LateRows`` and publishes nothing.  Rows of one order within a key
are tied, as in any window; null keys are a key like others.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.scan import running_scan
from kestrel.session import stored

_NEW, _UPTO = "_new", "_upto"


class LateRows(ValueError):
    """A batch holds rows that order before rows of their key in an earlier batch."""


def batches(spark: SparkSession, path: str) -> list[dict]:
    """The published batches at ``path`` by number (a small row for each); the last line of a number holds."""
    try:
        lines = [json.loads(r[0]) for r in spark.read.text(f"{path}/manifest").collect()]
    except AnalysisException:
        return []
    newest = {}
    for line in sorted(lines, key=lambda m: m["line"]):
        newest[line["batch"]] = line
    return [newest[b] for b in sorted(newest)]


def _publish(spark: SparkSession, path: str, batch: int, folder: str, base: bool) -> None:
    try:
        line = spark.read.text(f"{path}/manifest").count()
    except AnalysisException:
        line = 0
    entry = json.dumps({"line": line, "batch": batch, "folder": folder, "base": base})
    spark.createDataFrame([(entry,)], "entry string").coalesce(1).write.mode("append").text(f"{path}/manifest")


def carries(spark: SparkSession, path: str, keys: Sequence[str], before: int | None = None) -> DataFrame | None:
    """The newest carry of every key in the batches below ``before`` (all, if None); None where there are none."""
    known = [b for b in batches(spark, path) if before is None or b["batch"] < before]
    starts = [i for i, b in enumerate(known) if b["base"]]
    known = known[starts[-1]:] if starts else known
    if not known:
        return None
    parts = [spark.read.parquet(f"{path}/{b['folder']}").withColumn("_batch", F.lit(b["batch"])) for b in known]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    values = [c for c in both.columns if c not in keys and c != "_batch"]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_carry"))
    return newest.select(*keys, "_carry.*")


def compact(spark: SparkSession, path: str, keys: Sequence[str]) -> None:
    """All carries as one folder under the newest batch's number, so that later batches read no older ones."""
    known = batches(spark, path)
    if known:
        folder = f"carries-{uuid.uuid4().hex}"
        carries(spark, path, keys).write.parquet(f"{path}/{folder}")
        _publish(spark, path, known[-1]["batch"], folder, True)


def incremental_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], aggs: Mapping[str, tuple], path: str, batch: int,
                     num_blocks: int | None = None) -> DataFrame:
    """``running_scan`` of the rows of ``df`` as batch number ``batch`` behind the batches below it at ``path``.

    ``aggs`` as in ``running_scan`` and the same for all batches; batch numbers rise, and the newest one may be run again.
    """
    keys, order = list(keys), list(order)
    if not keys:
        raise ValueError("an incremental scan needs a key")
    spark = df.sparkSession
    if any(b["batch"] > batch for b in batches(spark, path)):
        raise ValueError(f"later batches than {batch} stand on the carries at {path}")
    place = F.struct(*[F.col(c) for c in order])
    # each aggregate has an input column of its own, which on a carry holds the value so far
    value = {n: F.lit(1).cast("bigint") if s[0] == "count" else F.col(s[1]) for n, s in aggs.items()}
    sums = df.agg(F.count(F.lit(1)), *[F.sum(s[1]).alias(n) for n, s in aggs.items() if s[0] == "sum"]).schema
    value |= {n: v.cast(sums[n].dataType) for n, v in value.items() if aggs[n][0] == "sum"}
    behind = [c for c in order if c not in keys]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *keys, *behind, F.lit(1).alias(_NEW), place.alias(_UPTO),
                     *[v.alias(f"_in_{n}") for n, v in value.items()])
    rows = stored(rows, "batch-rows")
    both = rows
    old = carries(spark, path, keys, before=batch)
    if old is not None:
        here = rows.select(*[F.col(k).alias(f"_h_{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
        empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("_row", *behind)]
        first = old.join(here, same, "leftsemi").select(*keys, *empty, F.lit(0).alias(_NEW), _UPTO, *[f"_in_{n}" for n in aggs])
        both = stored(rows.unionByName(first), "batch-rows-with-carries")

    at = F.struct(F.col(_NEW), F.col(_UPTO))
    total = []
    for n, (kind, *_) in aggs.items():
        col = F.col(f"_in_{n}")
        if kind in ("count", "sum"):
            total.append(F.coalesce(F.sum(col), F.lit(0)).cast(rows.schema[f"_in_{n}"].dataType).alias(f"_in_{n}"))
        elif kind == "last":
            total.append(F.max_by(col, F.when(col.isNotNull(), at)).alias(f"_in_{n}"))
        elif kind == "first":
            total.append(F.min_by(col, at).alias(f"_in_{n}"))
        elif kind == "first_nonnull":
            total.append(F.min_by(col, F.when(col.isNotNull(), at)).alias(f"_in_{n}"))
        else:
            raise ValueError(f"unknown scan aggregate {kind!r}")
    late = F.max(F.when(F.col(_NEW) == 0, F.col(_UPTO))) > F.min(F.when(F.col(_NEW) == 1, F.col(_UPTO)))
    after = stored(both.groupBy(*keys).agg(F.max(_UPTO).alias(_UPTO), *total, F.coalesce(late, F.lit(False)).alias("_late")), "batch-carries")
    n_late = after.where("_late").count()
    if n_late:
        raise LateRows(f"{n_late} keys have rows in batch {batch} that order before rows of earlier batches")

    # a count is the sum of ones and of the carried count
    scans = {n: ("sum" if s[0] == "count" else s[0], f"_in_{n}", *s[2:3]) for n, s in aggs.items()}
    scanned = running_scan(both, keys, [_NEW, *behind], scans, num_blocks).where(F.col(_NEW) == 1)
    out = stored(scanned.select("_row.*", *aggs), "batch-result")
    folder = f"carries-{uuid.uuid4().hex}"
    after.drop("_late").write.parquet(f"{path}/{folder}")
    _publish(spark, path, batch, folder, False)
    return out
