"""running_scan equals the plain window, also with one key holding a third of the rows."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from kestrel.operators.scan import running_scan


def _fixture(spark, n=3000):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        k = 0 if i % 3 == 0 else rnd.randint(1, 60)  # key 0 holds a third of all rows
        v = None if rnd.random() < 0.2 else rnd.randint(0, 9)
        rows.append((k, rnd.randint(0, 50), i, v))
    return spark.createDataFrame(rows, "k long, t long, id long, v long")


def test_scan_matches_window(spark):
    df = _fixture(spark)
    aggs = {
        "n_before": ("count", None),
        "s_before": ("sum", "v"),
        "s_incl": ("sum", "v", True),
        "last_v": ("last", "v"),
        "first_v": ("first", "v", True),
        "first_nn": ("first_nonnull", "v", True),
    }
    got = running_scan(df, ["k"], ["t", "id"], aggs, num_blocks=6)
    w = Window.partitionBy("k").orderBy("t", "id")
    ex = w.rowsBetween(Window.unboundedPreceding, -1)
    inc = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "k", "t", "id", "v",
        F.count(F.lit(1)).over(ex).alias("n_before"),
        F.coalesce(F.sum("v").over(ex), F.lit(0)).alias("s_before"),
        F.coalesce(F.sum("v").over(inc), F.lit(0)).alias("s_incl"),
        F.last("v", True).over(ex).alias("last_v"),
        F.first("v").over(inc).alias("first_v"),
        F.first("v", True).over(inc).alias("first_nn"),
    )
    cols = ["k", "t", "id", "v", "n_before", "s_before", "s_incl", "last_v", "first_v", "first_nn"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_global_scan(spark):
    df = _fixture(spark, 500)
    got = running_scan(df, [], ["t", "id"], {"pos": ("count", None)}, num_blocks=5)
    positions = sorted(r.pos for r in got.collect())
    assert positions == list(range(500))


def test_composite_key_and_null_order(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(2000):
        a = 0 if i % 2 == 0 else rnd.randint(1, 5)          # half the rows share a = 0
        b = "x" if i % 3 else "y"
        t = None if rnd.random() < 0.05 else rnd.randint(0, 30)
        rows.append((a, b, t, i, rnd.randint(0, 4)))
    df = spark.createDataFrame(rows, "a long, b string, t long, id long, v long")
    got = running_scan(df, ["a", "b"], ["t", "id"], {"n": ("count", None), "s": ("sum", "v", True)}, num_blocks=7)
    w = Window.partitionBy("a", "b").orderBy(F.col("t").asc_nulls_first(), "id")
    want = df.select("a", "b", "t", "id", "v",
                     F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("n"),
                     F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    cols = ["a", "b", "t", "id", "v", "n", "s"]
    assert sorted(got.select(*cols).collect(), key=lambda r: r.id) == sorted(want.select(*cols).collect(), key=lambda r: r.id)


def test_null_keys_span_blocks(spark):
    rows = [(None if i % 2 == 0 else i % 7, i, i % 3) for i in range(1500)]   # half the rows have a null key
    df = spark.createDataFrame(rows, "k long, id long, v long")
    got = running_scan(df, ["k"], ["id"], {"n": ("count", None), "s": ("sum", "v"), "f": ("first", "v", True)},
                       num_blocks=9)
    w = Window.partitionBy("k").orderBy("id")
    want = df.select("k", "id", "v",
                     F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("n"),
                     F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"),
                     F.first("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("f"))
    cols = ["k", "id", "v", "n", "s", "f"]
    assert sorted(got.select(*cols).collect(), key=lambda r: r.id) == sorted(want.select(*cols).collect(), key=lambda r: r.id)
