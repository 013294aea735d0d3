"""Intermediate tables in the cluster's shared folder, and column helpers of the operators."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, read from the session (an error on a cluster that names none)."""
    return ensure_checkpoint_dir(spark).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage is cut, columns can be
    pruned, and a lost executor costs a re-read at most."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"


def plain(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input (whatever their names) never clash.

    Texts go to Python in Arrow batches of a few MB, however long they are: where the session keeps Spark's default
    bound of a batch, a smaller one is set, which bounds the memory of the task on both sides.
    """
    conf = docs.sparkSession.conf
    if conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return docs.select(*[F.col(f"`{c}`") for c in columns])


BROADCAST_ROWS = 1_000_000  # keys are broadcast up to this count (some tens of MB); beyond it they are shuffled


def without(docs: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` that match no row of ``keys`` in all its columns (nulls match nulls); the columns of
    ``keys`` bear names ``docs`` has not."""
    keys = written(keys.distinct(), name)
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    match = None
    for c in keys.columns:
        own = docs[c.removeprefix("gone_")].eqNullSafe(keys[c])
        match = own if match is None else match & own
    return docs.join(keys, match, "left_anti")


def ship(spark: SparkSession, model):
    """Broadcast a model of bounded size, classes included, so that workers need not have this package."""
    from pyspark import cloudpickle

    return spark.sparkContext.broadcast({"pickled": cloudpickle.dumps(model)})


def shipped(broadcast):
    """The model sent by ``ship``; unpickled once by each Python worker, which keeps its broadcast values."""
    from pyspark import cloudpickle

    held = broadcast.value
    if "model" not in held:
        held["model"] = cloudpickle.loads(held["pickled"])
    return held["model"]
