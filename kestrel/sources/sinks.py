"""Sinks (S2-S4, S8): result tables as CSV, nested reports as JSON, transcripts as text.

Only result tables (a sweep, a confusion matrix, a report row) are coalesced to one file;
transcripts are packed into one file for each partition by all tasks in parallel, without gathering any conversation
into one row.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_result_csv(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header, no index column."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report_json(df: DataFrame, path: str) -> None:
    """A one-row report of nested structs/arrays; values JSON cannot hold become strings."""
    conv = df
    for f in df.schema.fields:
        if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz", "decimal", "binary"):
            conv = conv.withColumn(f.name, F.col(f.name).cast("string"))
    conv.coalesce(1).write.mode("overwrite").json(path)


def write_transcripts(lines: DataFrame, path: str, key: str = "conv_id", order: Sequence[str] = ("turn",),
                      line: str = "line", num_partitions: int | None = None) -> None:
    """The transcripts of all conversations, packed into one text file for each partition (``sources.transcripts``).

    Rows are range-partitioned on (conversation, turn) and sorted within each partition, then streamed to the writer:
    nothing gathers a conversation into one row or one task.  A very long conversation spans several partitions.
    """
    from kestrel.sources.transcripts import NAME, TranscriptSource

    spark = lines.sparkSession
    spark.dataSource.register(TranscriptSource)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [key, *order]
    ordered = lines.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    ordered.select(F.col(key).cast("long").alias("conv_id"), F.col(line).alias("line")).write.format(NAME).mode("append").save(path)


def read_transcripts(spark, path: str) -> DataFrame:
    """``conv_id, part, text``: every segment that ``write_transcripts`` published."""
    from kestrel.sources.transcripts import NAME, TranscriptSource

    spark.dataSource.register(TranscriptSource)
    return spark.read.format(NAME).load(path)


def write_vector_table(df: DataFrame, path: str, vec: str = "embedding") -> None:
    """The vector table (ids, document metadata, unit-length float vectors) as parquet.

    Vectors are normalised once here so that search is a plain inner product; no separate
    index file exists: the table is the index.
    """
    from kestrel.operators.retrieval import unit_vectors

    unit_vectors(df, vec).write.mode("overwrite").parquet(path)


ORDERS_SCHEMA = ("order_id long, product_category string, price_inr double, discount_pct double, "
                 "payment_method string, customer_tenure_days int, num_previous_orders int, "
                 "num_previous_returns int, delivery_distance_km double, delivery_days int, "
                 "is_weekend_order int, rating_given double, returned int")
BAD_RECORD = "_bad_record"


def read_orders_csv(spark, path: str, header: bool = True, on_bad: str = "fail") -> DataFrame:
    """The typed 13-column orders table from CSV (explicit schema, no inference; a header is held to it).

    A record whose field does not parse, or that has fewer or more fields, is bad: ``on_bad`` is ``fail`` (a query stops at the
    first bad value that it reads) or ``mark`` (the record's text stands in the column ``_bad_record``, which is null for good ones;
    ``split_bad_records`` parts them).  An empty field is a null, not a fault.
    """
    mode = {"fail": "FAILFAST", "mark": "PERMISSIVE"}[on_bad]
    schema = ORDERS_SCHEMA + (f", {BAD_RECORD} string" if on_bad == "mark" else "")
    return (spark.read.schema(schema).option("header", header).option("enforceSchema", not header).option("mode", mode)
            .option("columnPruning", False)  # else the number of fields would not be checked where a query reads a few
            .option("columnNameOfCorruptRecord", BAD_RECORD).csv(path))


def split_bad_records(marked: DataFrame, name: str = "orders") -> tuple[DataFrame, DataFrame]:
    """The good rows, typed, and the quarantine (``_bad_record``: the records as they stand in the file); the files are read
    once, into the shared folder."""
    from kestrel.session import stored

    held = stored(marked, f"{name}-marked")
    return held.where(F.col(BAD_RECORD).isNull()).drop(BAD_RECORD), held.where(F.col(BAD_RECORD).isNotNull()).select(BAD_RECORD)
