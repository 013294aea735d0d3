"""The tasks that sort and add up postings grow with their number, so that the memory of one does not."""
from pyspark.sql import functions as F

from kestrel.operators import postings as PO


def test_tasks_grow_with_the_postings(spark, monkeypatch):
    chunks = spark.range(300).select(F.format_string("%d-00", "id").alias("chunk_id"), F.col("id").cast("string").alias("doc_id"),
                                     F.concat_ws(" ", F.lit("refund"), F.format_string("w%d", F.col("id") % 50), F.format_string("x%d", "id")).alias("text"))
    asked = [(0, "refund w7"), (1, "x12")]
    usual = PO.build(chunks, 16)
    want = sorted(map(tuple, PO.search(usual, asked).collect()))
    few = len(usual.blocks.inputFiles())
    monkeypatch.setattr(PO, "PARTITION_ROWS", 20)
    many = PO.build(chunks, 16)
    assert len(many.blocks.inputFiles()) > max(few, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert sorted(map(tuple, PO.search(many, asked).collect())) == want and len(want) == 4
