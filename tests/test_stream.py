"""The stateful stream equals the batch carry, in whatever order the files bring the turns."""
import os
import random

from pyspark.sql import functions as F

from kestrel.operators import messages as MS
from kestrel.plans.messages_plans import support_turns
from kestrel.streaming.conversations import PROVIDER, ROCKSDB, carry_stream, latest, run_to_table
from conftest import SF01
from test_messages import SENTENCES


def planted(spark):
    """The user turns of the table with the planted sentences as their texts, so that every branch is met."""
    turns = support_turns(spark, SF01).select("conv_id", "turn")
    text = F.element_at(F.array(*[F.lit(t) for t in SENTENCES]), (F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(len(SENTENCES))) + 1).cast("int"))
    return turns.withColumn("text", text)


def carried(df):
    return {(r.conv_id, r.turn): (r.intent, r.features_source_text, r.image_path) for r in df.collect()}


def run(spark, parts, folder, name, **how):
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(os.path.join(folder, f"b{k:02d}"))
    src = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    written = run_to_table(spark, carry_stream(src, **how), name)
    return latest(written)


def test_stream_in_turn_order_matches_batch(spark, tmp_path):
    turns = planted(spark)
    want = carried(MS.carry_context(MS.guard_and_route(turns)))
    got = carried(run(spark, [turns.where(F.col("turn") == k) for k in range(8)], str(tmp_path), "in-order"))
    assert got == want and any(v[1] for v in want.values()) and any(v[2] for v in want.values())


def test_stream_of_shuffled_files_matches_batch(spark, tmp_path):
    turns = planted(spark).where("conv_id < 60")
    keys = [(r.conv_id, r.turn) for r in turns.collect()]
    rnd = random.Random(1)
    file_of = spark.createDataFrame([(c, t, rnd.randrange(5)) for c, t in keys], "conv_id long, turn long, f int")
    dealt = turns.join(file_of, ["conv_id", "turn"])
    parts = [dealt.where(F.col("f") == k).select("conv_id", "turn", "text") for k in range(5)]
    parts.append(turns.where("turn = 0").limit(3))  # turns that are seen again
    want = carried(MS.carry_context(MS.guard_and_route(turns)))
    assert carried(run(spark, parts, str(tmp_path), "shuffled")) == want
    late_first = [turns.where("turn >= 3"), turns.where("turn < 3")]
    assert carried(run(spark, late_first, str(tmp_path / "late"), "late-first")) == want


def test_hot_conversation_is_split_into_blocks(spark, tmp_path):
    """One conversation of a third of all turns, in files of any order: equal to the batch carry, state bounded by the block."""
    turns = planted(spark)
    n = turns.count() // 2
    hot = spark.range(n).selectExpr("-1L as conv_id", "id * 3 as turn")
    text = F.element_at(F.array(*[F.lit(t) for t in SENTENCES]), (F.pmod(F.xxhash64("turn"), F.lit(len(SENTENCES))) + 1).cast("int"))
    # context that only an early block holds must reach the last ones
    text = F.when(F.col("turn") < 30, text).otherwise(F.lit("What is the risk of this order?"))
    turns = turns.unionByName(hot.withColumn("text", text)).where("conv_id < 40")
    parts = [turns.where(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == k) for k in (2, 0, 3, 1)]
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"b{k:02d}"))
    src = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    written = run_to_table(spark, carry_stream(src, block_turns=16), "hot")
    assert written.groupBy("conv_id", "block").agg(F.countDistinct("turn").alias("n")).agg(F.max("n")).first()[0] <= 16
    assert written.where("conv_id = -1").select("block").distinct().count() > 20
    got, want = carried(latest(written, num_blocks=5)), carried(MS.carry_context(MS.guard_and_route(turns)))
    assert got == want and len({v for k, v in want.items() if k[0] == -1}) > 1


def test_state_expires(spark, tmp_path):
    """A turn that comes after the state's time to live does not see its block's earlier turn; within it, it does."""
    rows = [(1, 0, "price 1200, is the return risk high?"), (1, 1, "and the risk now?")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    found = {}
    for name, expire_ms in (("gone", 1), ("kept", 3_600_000)):
        base = tmp_path / name
        for k in (0, 1):  # one batch for each file, from one checkpoint
            turns.where(F.col("turn") == k).coalesce(1).write.parquet(str(base / "in" / f"b{k}"))
            src = spark.readStream.schema(turns.schema).option("recursiveFileLookup", "true").parquet(str(base / "in"))
            q = carry_stream(src, expire_ms=expire_ms).writeStream.format("parquet").option("checkpointLocation", str(base / "checkpoint")).trigger(once=True).start(str(base / "out"))
            assert q.awaitTermination(60)
        found[name] = spark.read.parquet(str(base / "out")).where("turn = 1").first().detail_text
    spark.conf.set(PROVIDER, before)
    assert found == {"gone": None, "kept": rows[0][2]}
