"""A postings index over text chunks with block maxima, and top-k search that skips blocks which cannot enter.

*Chunks* are distinct (chunk id, text) pairs: repeated rows are one chunk, rows that share an id but not their text stay apart.
*Impact* of a term in a chunk: its count divided by the chunk's vector length, so a score is a cosine of term vectors.
*Blocks*: chunks are put into blocks by their vector length (short chunks have large impacts, long ones small ones) and, inside
a length class, by hash, some ``BLOCK_CHUNKS`` to a block.  The index has one row for each term and block: the postings,
their number and the largest impact.  It is built in one scan of the texts: a pass that counts terms inside each row, and
one shuffle by range of (term, block); repeated rows collapse before it inside a batch, and after it for good.

*Search* of a list of queries reads the rows of the queries' terms only.  Their counts give the weights (inverse document
frequency), the maxima give each block's bound for each query.  A query first scores its ``FIRST`` best blocks, which sets the
score that its k-th chunk reaches at least; then it scores the other blocks whose bound reaches that score, and no others.
Results are those of scoring every chunk.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.operators.retrieval import TOP_K, term_counts, terms
from kestrel.session import stored

BLOCK_CHUNKS = 4096
FIRST = 2
PARTITION_ROWS = 2_000_000  # postings that one task sorts, some 200 MB
LENGTH_CLASSES = 4  # classes of vector length in each doubling
ALL = ""  # the term of every chunk (no term is empty): its postings count the chunks


@dataclass
class Postings:
    """``blocks``: (term, block, n, top, postings array<struct<key, impact>>); ``chunks``: (key, chunk_id, doc_id), for
    the names of results."""

    blocks: DataFrame
    chunks: DataFrame

    def save(self, path: str) -> None:
        self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        self.chunks.select("key", "chunk_id", "doc_id").write.mode("overwrite").parquet(f"{path}/chunks")

    def size(self) -> int:
        return self.blocks.where(F.col("term") == ALL).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def load(spark: SparkSession, path: str) -> Postings:
    return Postings(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/chunks"))


FLAT = "term string, key long, kind int, impact double, chunk_id string, doc_id string"


def _impacts(batches):
    """(key, chunk_id, doc_id, terms) to one row for each different term of a chunk (its count over the chunk's vector length)
    and one of ALL, which carries the names.  Chunks that repeat inside a batch are taken once."""
    for batch in batches:
        keys, once = np.unique(np.asarray(batch.column(0)), return_index=True)
        batch = batch.take(pa.array(once))
        lists = batch.column(3)
        size = np.diff(np.asarray(lists.offsets)).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(keys)), size)
        width = max(len(words.dictionary), 1)
        found, count = np.unique(row * width + np.asarray(words.indices, dtype=np.int64), return_counts=True)
        row, word = found // width, found % width
        length = np.sqrt(np.bincount(row, weights=count.astype(float) ** 2, minlength=len(keys)))
        some = np.flatnonzero(length > 0)  # a chunk without terms has no postings
        own = np.concatenate([row, some])
        kind = np.floor(LENGTH_CLASSES * np.log2(np.maximum(length[own], 1))).astype(np.int32)
        none = pa.nulls(len(row), pa.string())
        yield pa.RecordBatch.from_arrays([
            pa.concat_arrays([words.dictionary.take(pa.array(word)), pa.array([ALL] * len(some), pa.string())]), pa.array(keys[own]), pa.array(kind),
            pa.array(np.concatenate([count / length[row], np.ones(len(some))])),
            *[pa.concat_arrays([none, batch.column(c).take(pa.array(some))]) for c in (1, 2)]], names=["term", "key", "kind", "impact", "chunk_id", "doc_id"])


BLOCKS = "term string, block long, n long, top double, postings array<struct<key: long, impact: double>>"


def _blocks(batches):
    """Rows sorted by (term, block, key) to one row for each term and block; a repeated key is one posting."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if not table.num_rows:
            continue
        start = _starts(table)
        last = int(start[-1])  # the last run may go on in the next batch
        if last:
            yield _packed(table.slice(0, last), start[:-1])
        rest = table.slice(last).combine_chunks()
        held = rest.to_batches()[0]
    if held is not None:
        yield _packed(pa.Table.from_batches([held]), np.zeros(1, np.int64))


def _changes(column) -> np.ndarray:
    column = column.combine_chunks()
    column = column.dictionary_encode().indices if pa.types.is_string(column.type) else column
    values = np.asarray(column)
    return np.concatenate(([True], values[1:] != values[:-1]))


def _starts(table) -> np.ndarray:
    return np.flatnonzero(_changes(table["term"]) | _changes(table["block"]))


def _packed(table, start):
    first = np.zeros(table.num_rows, bool)
    first[start] = True
    keep = np.flatnonzero(first | _changes(table["key"]))
    rows = table.take(pa.array(keep)).combine_chunks()
    begin = np.searchsorted(keep, start)
    impact = np.asarray(rows["impact"])
    postings = pa.StructArray.from_arrays([rows["key"].combine_chunks(), rows["impact"].combine_chunks()], names=["key", "impact"])
    ends = np.concatenate((begin[1:], [len(keep)]))
    return pa.RecordBatch.from_arrays([rows["term"].combine_chunks().take(pa.array(begin)), rows["block"].combine_chunks().take(pa.array(begin)), pa.array(ends - begin, pa.int64()),
                                       pa.array(np.maximum.reduceat(impact, begin)), pa.ListArray.from_arrays(pa.array(np.concatenate((begin, [len(keep)])), pa.int32()), postings)],
                                      names=["term", "block", "n", "top", "postings"])


def partitions(spark: SparkSession, postings: int) -> int:
    """Tasks that postings are shuffled to: the session's number, or more, so that a task has some PARTITION_ROWS at most."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-postings // PARTITION_ROWS))


def build(chunks: DataFrame, block_chunks: int = BLOCK_CHUNKS) -> Postings:
    """Index ``chunks`` (chunk_id, doc_id, text) in the shared folder: one scan of the texts, one shuffle of their postings."""
    spark = chunks.sparkSession
    own = chunks.where("text is not null").select(F.xxhash64("chunk_id", "text").alias("key"), "chunk_id", F.col("doc_id").cast("string").alias("doc_id"), terms(F.col("text")).alias("terms"))
    flat = stored(own.mapInArrow(_impacts, FLAT), "postings-flat")
    counts = {r["kind"]: r["n"] for r in flat.where(F.col("term") == ALL).groupBy("kind").agg(F.approx_count_distinct("key").alias("n")).collect()}  # length classes
    split = F.element_at(F.create_map(*[F.lit(x) for k, n in (counts or {0: 1}).items() for x in (k, -(-n // block_chunks))]), F.col("kind"))
    # the class stands in the high digits, so that a block holds chunks of one length class
    flat = flat.withColumn("block", F.col("kind").cast("long") * F.lit(1 << 32) + F.pmod("key", split.cast("long")))
    n = partitions(spark, flat.count())
    # by range of terms, so that a search reads the files and row groups of its terms; a frequent term spans several tasks
    ranged = flat.select("term", "block", "key", "impact").repartitionByRange(n, "term", "block").sortWithinPartitions("term", "block", "key")
    return Postings(stored(ranged.mapInArrow(_blocks, BLOCKS), "postings-blocks"), flat.where(F.col("term") == ALL).select("key", "chunk_id", "doc_id"))


# ------------------------------------------------------------------ search
def weights(index: Postings, queries: Sequence[tuple[int, str]]) -> list[tuple[int, str, float]]:
    """(query, term, weight) of unit length for each query of the list: count times inverse document frequency."""
    spark = index.blocks.sparkSession
    asked = term_counts(spark.createDataFrame(list(queries), "query_id long, text string"), ["query_id"]).select("query_id", "term", "tf").collect()  # the list's terms
    listed = [*{r["term"] for r in asked}, ALL]
    seen = {r["term"]: r["n"] for r in index.blocks.where(F.col("term").isin(listed)).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    raw = [(r["query_id"], r["term"], r["tf"] * (math.log((1 + seen.get(ALL, 0)) / (1 + seen.get(r["term"], 0))) + 1)) for r in asked]
    length: dict[int, float] = {}
    for q, _, w in raw:
        length[q] = length.get(q, 0.0) + w * w
    return [(q, t, w / math.sqrt(length[q])) for q, t, w in raw]


def _scored(index: Postings, listed: Sequence[str], wanted: DataFrame) -> DataFrame:
    """``query_id, key, score`` of every chunk in the (query, term, w, block, n) rows ``wanted``."""
    n = partitions(index.blocks.sparkSession, wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    held = index.blocks.where(F.col("term").isin(list(listed))).select("term", "block", "postings").join(wanted.drop("n"), ["term", "block"])
    flat = held.select("query_id", "w", F.explode("postings").alias("p")).select("query_id", F.col("p.key").alias("key"), (F.col("w") * F.col("p.impact")).alias("part"))
    return flat.repartition(n, "query_id", "key").groupBy("query_id", "key").agg(F.round(F.sum("part"), 9).alias("score"))


def _kth(scored: DataFrame, k: int) -> DataFrame:
    """``query_id, least``: the score of each query's k-th chunk, one row for each query of the list at most (a task hands on
    k rows of a query)."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key")
    place = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return _local(place.where(F.col("place") == k).select("query_id", F.col("score").alias("least")))


def _local(few: DataFrame) -> DataFrame:
    """Rows whose number the list of queries bounds, as a local table that is broadcast."""
    return F.broadcast(few.sparkSession.createDataFrame(few.collect(), few.schema))


def visits(index: Postings, queries: Sequence[tuple[int, str]], k: int = TOP_K, first: int = FIRST):
    """The (query, block) pairs that a search scores: the scores of each query's ``first`` blocks, the pairs after them that can
    still enter, and the scorer of such pairs."""
    w = weights(index, queries)
    listed = list({t for _, t, _ in w})
    w = index.blocks.sparkSession.createDataFrame(w, "query_id long, term string, w double")
    rows = index.blocks.where(F.col("term").isin(listed)).select("term", "block", "n", "top").join(F.broadcast(w), "term")
    rows = stored(rows.select("query_id", "term", "w", "block", "n", "top"), "postings-bounds")
    bounds = rows.groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))
    best = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    opening = _local(bounds.withColumn("place", F.row_number().over(best)).where(F.col("place") <= first).select("query_id", "block"))

    def score(pairs: DataFrame) -> DataFrame:
        return _scored(index, listed, rows.join(pairs, ["query_id", "block"]))

    early = stored(score(opening), "postings-first")
    reach = F.col("bound") + 1e-8 >= F.coalesce("least", F.lit(0.0))
    rest = bounds.join(_kth(early, k), "query_id", "left").where(reach).select("query_id", "block").join(opening, ["query_id", "block"], "left_anti")
    return early, rest, score


def search(index: Postings, queries: Sequence[tuple[int, str]], k: int = TOP_K, first: int = FIRST) -> DataFrame:
    """``query_id, rank, chunk_id, doc_id, score``: the k best chunks of each query that share a term with it (equal scores: the
    smaller chunk id, then the smaller text hash)."""
    early, rest, score = visits(index, queries, k, first)
    every = early.unionByName(score(rest))
    near = stored(every.where("score > 0"), "postings-scored")
    # the k-th score and what equals it: names decide between equal scores
    near = near.join(_kth(near, k), "query_id", "left").where(F.col("score") >= F.coalesce("least", F.lit(0.0))).drop("least")
    named = index.chunks.select("key", "chunk_id", "doc_id").join(near, "key").groupBy("query_id", "key", "chunk_id", "doc_id").agg(F.max("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id", "key")
    return named.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "doc_id", "score")
