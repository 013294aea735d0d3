"""Carried order context as a stateful stream keyed by blocks of a conversation's turns.

Turns arrive as files, in any order; guardrail, intent and detail detection are stateless column expressions.  The
stateful operator (``transformWithState``) is keyed by (``conv_id``, block of ``BLOCK_TURNS`` turn numbers), so a conversation of
any length is dealt over all tasks and the state of a key holds ``BLOCK_TURNS`` turns at most.  Its list state has the turns seen
(risk texts and image paths, where a turn has one).  When turns arrive, the block's context from the smallest new turn on is worked out again
and emitted under the next ``version``, so a late turn corrects the ones after it in its block and nothing is dropped; a
turn that is seen again replaces itself.

What a block hands to the later ones is its last emitted context.  ``latest`` reads the table that the stream wrote: it keeps the last
version of each turn, runs the blocks' carries over each conversation (``running_scan``, which splits a long one) and fills
each turn's context up from the carry into its block.

The turns carry no event time, so there is no watermark; ``expire_ms`` is the state's time to live after its last change, for callers who
know how late a turn may come (a turn that comes later still sees all other blocks, but not its own block's expired turns).

Output per turn: the text whose features the turn uses (``features_source_text``) and the image path; features
are then extracted with the same column expressions as the batch job.
"""
from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kestrel.functions import text_rules as T
from kestrel.operators.messages import guard_and_route
from kestrel.operators.scan import running_scan
from kestrel.session import ensure_checkpoint_dir

BLOCK_TURNS = 64
OUTPUT_SCHEMA = ("conv_id long, block long, turn long, intent string, mentions_details boolean, "
                 "detail_text string, first_text string, path string, version long")
TURN_SCHEMA = "turn long, intent string, mentions_details boolean, risk_text string, path_here string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _order(turn):
    return (turn is not None, turn or 0)  # a null turn comes first, as it does in the batch job


class BlockCarry(StatefulProcessor):
    """The context inside one block of one conversation."""

    def __init__(self, expire_ms: int | None = None):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", TURN_SCHEMA, self.expire_ms)
        self.version = handle.getValueState("version", "version long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {t[0]: tuple(t) for t in self.turns.get()} if self.turns.exists() else {}
        least = None
        for r in rows:
            held[r.turn] = (r.turn, r.intent, r.mentions_details, r.risk_text, r.path_here)
            least = _order(r.turn) if least is None else min(least, _order(r.turn))
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        order = sorted(held, key=_order)
        self.turns.put([held[t] for t in order])
        self.version.update((version,))
        detail = first = path = None
        for t in order:
            _, intent, mentions, risk_text, path_here = held[t]
            if risk_text is not None:
                first = risk_text if first is None else first
                detail = risk_text if mentions else detail
            path = path if path_here is None else path_here
            if _order(t) >= least:
                yield Row(conv_id=key[0], block=key[1], turn=t, intent=intent, mentions_details=mentions, detail_text=detail, first_text=first, path=path, version=version)


def carry_stream(turns: DataFrame, block_turns: int = BLOCK_TURNS, expire_ms: int | None = None) -> DataFrame:
    """Streaming turns (conv_id, turn, text) -> each turn's context inside its block, by version.

    With ``expire_ms`` Spark runs batches for as long as the query stands, to drop what has expired: such a stream takes a
    continuous or single-batch trigger, not ``run_to_table``'s.
    """
    routed = guard_and_route(turns)
    prepared = routed.select(
        "conv_id", F.floor(F.col("turn") / block_turns).cast("long").alias("block"), "turn", "intent",
        T.mentions_details(F.col("text")).alias("mentions_details"),
        F.when(F.col("intent") == T.RISK, F.col("text")).alias("risk_text"),
        F.when(F.col("intent") == T.IMAGE, T.image_path(F.col("text"))).alias("path_here"),
    )
    return prepared.groupBy("conv_id", "block").transformWithState(
        BlockCarry(expire_ms), OUTPUT_SCHEMA, "Append", "None" if expire_ms is None else "ProcessingTime")


def latest(written: DataFrame, num_blocks: int | None = None) -> DataFrame:
    """The carried context of every turn that the stream has written: ``conv_id, turn, intent, mentions_details,
    features_source_text, image_path``."""
    rest = [c for c in written.columns if c not in ("conv_id", "block", "turn", "version")]
    turns = written.groupBy("conv_id", "block", "turn").agg(F.max_by(F.struct(*rest), "version").alias("x")).select("conv_id", "block", "turn", "x.*")
    last = F.max_by(F.struct("detail_text", "first_text", "path"), F.struct("turn"))
    ends = turns.groupBy("conv_id", "block").agg(last.alias("end")).select("conv_id", "block", "end.*")
    carry = running_scan(ends, ["conv_id"], ["block"], {
        "detail_in": ("last", "detail_text"), "first_in": ("first_nonnull", "first_text"), "path_in": ("last", "path")}, num_blocks)
    carry = carry.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "detail_in", "first_in", "path_in")
    both = turns.join(carry, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    source = F.coalesce("detail_text", "detail_in", "first_in", "first_text")
    return both.select("conv_id", "turn", "intent", "mentions_details", F.when(F.col("intent") == T.RISK, source).alias("features_source_text"),
                       F.when(F.col("intent") == T.IMAGE, F.coalesce("path", "path_in")).alias("image_path"))


def run_to_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream until its input is drained and return what it wrote, as a batch frame.

    Output and stream checkpoint go to a fresh folder under ``spark.checkpoint.dir``
    (the shared folder on a cluster), so a restarted query resumes from its checkpoint.
    """
    base = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # list state needs it; the session's own setting comes back below
    try:
        q = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", os.path.join(base, "out"))
             .option("checkpointLocation", os.path.join(base, "checkpoint"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(stream.schema).parquet(os.path.join(base, "out"))


def features_from_source(df: DataFrame) -> DataFrame:
    f = T.extract_order_features(F.col("features_source_text"))
    return df.select("*", f["price_inr"].alias("price_inr"), f["discount_pct"].alias("discount_pct"),
                     f["product_category"].alias("product_category"), f["payment_method"].alias("payment_method"))
