"""Batches over carries equal the whole scan, also with a key of a third of the rows; failed and repeated runs change nothing."""
import json
import random

import pytest
from pyspark.sql import functions as F

from kestrel.operators.features import customer_history
from kestrel.operators.incremental import LateRows, batches, carries, compact, incremental_scan
from kestrel.operators.scan import running_scan

AGGS = {"n": ("count", None), "s": ("sum", "v"), "si": ("sum", "v", True), "l": ("last", "v"), "f": ("first", "v", True),
        "nn": ("first_nonnull", "v", True)}


def _rows(spark, n=1200):
    rnd = random.Random(5)
    data = [(0 if i % 3 == 0 else None if i % 7 == 0 else rnd.randint(1, 90), i // 4, i, None if rnd.random() < 0.3 else rnd.randint(0, 9), "x")
            for i in range(n)]
    return spark.createDataFrame(data, "k long, t long, id long, v int, `a.b` string").repartition(5)


def _seen(df):
    return sorted(map(str, df.select("k", "t", "id", "v", "`a.b`", *AGGS).collect()))


def test_batches_equal_the_whole(spark, tmp_path):
    df, path = _rows(spark), str(tmp_path / "state")
    want = running_scan(df, ["k"], ["t", "id"], AGGS, num_blocks=5)
    parts = [df.where("id < 300"), df.where("id >= 300 and id < 700"), df.where("id >= 700")]
    got = [_seen(incremental_scan(p, ["k"], ["t", "id"], AGGS, path, i, num_blocks=5)) for i, p in enumerate(parts[:2])]
    # the newest batch again, as after a lost driver: the same rows, and the later batch stands on it
    assert _seen(incremental_scan(parts[1], ["k"], ["t", "id"], AGGS, path, 1, num_blocks=5)) == got[1]
    # a run that stopped before its line in the manifest is not read
    spark.range(3).write.parquet(f"{path}/carries-stopped")
    compact(spark, path, ["k"])
    got.append(_seen(incremental_scan(parts[2], ["k"], ["t", "id"], AGGS, path, 2, num_blocks=5)))
    assert sorted(sum(got, [])) == _seen(want)
    assert [b["batch"] for b in batches(spark, path)] == [0, 1, 2]
    assert carries(spark, path, ["k"]).count() == df.select("k").distinct().count()
    with pytest.raises(ValueError):
        incremental_scan(parts[1], ["k"], ["t", "id"], AGGS, path, 1)


def test_late_rows_publish_nothing(spark, tmp_path):
    df, path = _rows(spark, 200), str(tmp_path / "state")
    incremental_scan(df.where("id >= 100"), ["k"], ["t", "id"], AGGS, path, 0).count()
    with pytest.raises(LateRows):
        incremental_scan(df.where("id < 100"), ["k"], ["t", "id"], AGGS, path, 1)
    assert [b["batch"] for b in batches(spark, path)] == [0]
    assert incremental_scan(df.limit(0), ["k"], ["t", "id"], AGGS, path, 1).count() == 0


def test_sums_of_small_integers_grow_past_their_type(spark, tmp_path):
    df = spark.createDataFrame([("a", i, 2**31 - 1) for i in range(4)], "k string, t int, v int")
    for i in range(2):
        out = incremental_scan(df.where((F.col("t") < 2) == F.lit(i == 0)), ["k"], ["t"], {"s": ("sum", "v", True)},
                               str(tmp_path / "state"), i)
    assert sorted(r.s for r in out.collect()) == [3 * (2**31 - 1), 4 * (2**31 - 1)]


def test_second_batch_reads_its_own_rows_only(spark, tmp_path):
    import datetime

    day = datetime.date(2024, 1, 1)
    rows = [(i, i % 9 if i % 3 else 0, day + datetime.timedelta(days=i // 5), i % 2) for i in range(600)]
    base = spark.createDataFrame(rows, "order_id long, customer_id long, order_day date, lr int")
    want = sorted(map(str, customer_history(base).collect()))
    path, got = str(tmp_path / "state"), []
    for i, half in enumerate(("order_id < 300", "order_id >= 300")):
        folder = str(tmp_path / f"orders-{i}")
        base.where(half).write.parquet(folder)
        got += list(map(str, customer_history(spark.read.parquet(folder), batch=(path, i)).collect()))
    assert sorted(got) == want
    held = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    assert set(held) == {"line", "batch", "folder", "base"}
