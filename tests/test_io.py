"""Sinks and sources round-trip: CSV result tables, JSON reports, per-conversation transcripts."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from kestrel.sources import sinks
from kestrel.sources.transcripts import transcript
from kestrel.operators.features import FEATURE_COLUMNS
from conftest import SF001


def test_orders_csv_roundtrip(spark):
    from kestrel.operators.features import order_features

    d = tempfile.mkdtemp(prefix="kestrel-io-")
    df = order_features(spark, SF001).select(*FEATURE_COLUMNS)
    sinks.write_result_csv(df, os.path.join(d, "orders"))
    back = sinks.read_orders_csv(spark, os.path.join(d, "orders"))
    assert back.count() == df.count()
    assert sorted(back.collect()) == sorted(df.collect())


def test_report_and_transcripts(spark):
    d = tempfile.mkdtemp(prefix="kestrel-io-")
    rep = spark.range(1).select(F.struct(F.lit(0.77).alias("accuracy")).alias("baseline"),
                                F.array(F.struct(F.lit("a").alias("feature"))).alias("top"))
    sinks.write_report_json(rep, os.path.join(d, "report"))
    assert spark.read.json(os.path.join(d, "report")).first()["baseline"]["accuracy"] == 0.77
    rows = [(1, t, f"line {t:02d}") for t in range(40, 0, -1)] + [(2, 1, "c")]
    lines = spark.createDataFrame(rows, "conv_id long, turn long, line string")
    sinks.write_transcripts(lines, os.path.join(d, "tr"), num_partitions=4)
    files = [f for f in os.listdir(os.path.join(d, "tr")) if f.endswith(".txt")]
    assert 1 < len(files) <= 4
    assert transcript(spark, os.path.join(d, "tr"), 1) == "".join(f"line {t:02d}\n" for t in range(1, 41))
    assert transcript(spark, os.path.join(d, "tr"), 2) == "c\n" and transcript(spark, os.path.join(d, "tr"), 3) == ""
    back = sinks.read_transcripts(spark, os.path.join(d, "tr")).collect()
    assert "".join(r.text for r in sorted(back) if r.conv_id == 1) == transcript(spark, os.path.join(d, "tr"), 1)


def test_many_conversations_share_files(spark, tmp_path):
    lines = spark.range(3000).selectExpr("id % 500 as conv_id", "id as turn", "concat('té ', id) as line")
    path = str(tmp_path / "tr")
    sinks.write_transcripts(lines, path, num_partitions=3)
    assert len([f for f in os.listdir(path) if f.endswith(".txt")]) == 3
    open(os.path.join(path, "part-00000-of-a-failed-attempt.txt"), "w").write("never read")  # the manifest does not name it
    got = {}
    for r in sorted(sinks.read_transcripts(spark, path).collect(), key=lambda r: r.part):
        got[r.conv_id] = got.get(r.conv_id, "") + r.text
    assert got == {c: "".join(f"té {t}\n" for t in range(c, 3000, 500)) for c in range(500)}
    assert transcript(spark, path, 7) == got[7]
    sinks.write_transcripts(lines.limit(0), str(tmp_path / "none"))
    assert sinks.read_transcripts(spark, str(tmp_path / "none")).collect() == []


def test_bad_records(spark, tmp_path):
    good = "1,Apparel,100.0,5.0,COD,10,2,1,3.5,4,0,,1"
    rows = [good, good.replace("100.0", "abc"), "2,Home,9", good + ",extra", ",,,,,,,,,,,,", "3,Home,1.5,0.0,COD,1,1,0,1.0,1,1,4.5,0"]
    path = str(tmp_path / "orders")
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(path)
    kept, bad = sinks.split_bad_records(sinks.read_orders_csv(spark, path, header=False, on_bad="mark"))
    assert sorted(r[0] for r in bad.collect()) == sorted(rows[1:4])
    assert sorted(str(r.order_id) for r in kept.collect()) == ["1", "3", "None"]
    with pytest.raises(Exception, match="MALFORMED"):
        sinks.read_orders_csv(spark, path, header=False).collect()
    other = str(tmp_path / "header")
    spark.createDataFrame([("a,b",), ("1,2",)], "value string").coalesce(1).write.text(other)
    with pytest.raises(Exception, match="header"):
        sinks.read_orders_csv(spark, other).collect()
