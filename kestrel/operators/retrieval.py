"""Chunking, sparse text scores, exact top-k vector search and retrieval evaluation.

Vector search takes a table of queries in blocks of bounded size (``vector_index``).  Text search compares a fixed list (the
knowledge base) with a table of any size in one pass, or a list of queries with a postings index (``postings``).

Texts are scored sparsely: a query's terms weigh their inverse document frequency, a chunk's terms
their count, and both sides are brought to unit length, so a score is a cosine between 0 and 1.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FIXED VALUES
# Splitting rule of the sentence splitter: after . ! ? and white space (of Unicode), before an ASCII capital.
SENTENCE_BOUNDARY = r"(?U)(?<=[.!?])\s+(?=[A-Z])"
# Groundedness: the top retrieved score must reach this for a policy answer.
GROUNDEDNESS_THRESHOLD = 0.45
TOP_K = 3

# White space of Unicode, which chunks are stripped of.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TERM = r"[\p{L}\p{N}]+"


# ------------------------------------------------------------------ R1, R2: chunking
def sentence_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    title: str | None = None) -> DataFrame:
    """R1 + R2: split each whole text into sentences, strip, drop empties, number them.

    ``chunk_id`` is ``<doc_id>-<index>`` with a two-digit index counted after dropping
    empty pieces.  Pure column expressions: split, transform, filter, posexplode.
    """
    strip = lambda c: F.btrim(c, F.lit(WHITE_SPACE))
    parts = F.filter(F.transform(F.split(strip(F.col(text)), SENTENCE_BOUNDARY), strip), lambda s: s != "")
    cols = [F.col(doc_id).alias("doc_id")] + ([F.col(title).alias("doc_title")] if title else [])
    out = docs.select(*cols, F.posexplode(parts).alias("idx", "text"))
    return out.select(
        F.format_string("%s-%02d", F.col("doc_id").cast("string"), F.col("idx")).alias("chunk_id"),
        *[c for c in ("doc_id", "doc_title") if c in out.columns], "idx", "text",
    )


# ------------------------------------------------------------------ R3: sparse text vectors
def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def term_counts(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """``keys``, ``term``, its count ``tf`` and the row's vector length ``norm``: ``term_vectors`` with a row for each term."""
    return term_vectors(df, keys, text).select(*keys, "norm", F.explode(F.arrays_zip("terms", "tfs")).alias("x")) \
        .select(*keys, F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"), "norm")


def term_vectors(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """``keys``, the different ``terms`` of the row, their counts ``tfs``, the number of all ``tokens`` and the vector length ``norm``
    (square root of summed squares).  One row for each row, counted for a batch of rows at a time, so rows stay in their task; ``keys`` may repeat.
    """
    own = df.select(*keys, terms(F.col(text)).alias("_terms"))
    return own.mapInArrow(_counted, T.StructType([*own.schema.fields[:-1], *VECTOR]))


VECTOR = [T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.DoubleType())),
          T.StructField("tokens", T.LongType()), T.StructField("norm", T.DoubleType())]


def _counted(batches):
    """(keys..., terms) to (keys..., different terms, counts, length of the vector); a null list has no terms."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        width = max(len(words.dictionary), 1)
        found, count = np.unique(np.repeat(np.arange(len(size)), size) * width + np.asarray(words.indices, dtype=np.int64), return_counts=True)
        row, tf = found // width, count.astype(float)
        norm = np.sqrt(np.bincount(row, weights=tf * tf, minlength=len(size)))
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(size))))), pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(found % width))),
                                          pa.ListArray.from_arrays(ends, pa.array(tf)), pa.array(size), pa.array(norm)],
                                         names=[*batch.schema.names[:-1], "terms", "tfs", "tokens", "norm"])


def scores_against_fixed_chunks(messages: DataFrame, key: Sequence[str], chunks: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """(``key``, chunk_id, doc_id, chunk_text, score) of every message and chunk of the fixed list that share a term."""
    spark = messages.sparkSession
    base = spark.createDataFrame(list(chunks), "chunk_id string, doc_id string, title string, chunk_text string")
    base_terms = term_counts(base, ["chunk_id", "doc_id", "chunk_text"], "chunk_text")
    df = {r[0]: r[1] for r in base_terms.groupBy("term").count().collect()}  # terms of the fixed list
    n = len(chunks)
    weight = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    table = spark.createDataFrame(list(weight.items()), "term string, idf double")
    unseen = math.log(1 + n) + 1
    own = term_counts(messages, key).drop("norm").join(F.broadcast(table), "term", "left")
    own = own.withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    length = own.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))
    held = own.where("idf is not null").select(*key, "term", "w").join(
        F.broadcast(base_terms.select("chunk_id", "doc_id", "chunk_text", "term", F.col("tf").alias("ctf"), F.col("norm").alias("cn"))), "term")
    summed = held.groupBy(*key, "chunk_id", "doc_id", "chunk_text").agg(F.sum(F.col("w") * F.col("ctf") / F.col("cn")).alias("dot"))
    return summed.join(length, list(key)).select(*key, "chunk_id", "doc_id", "chunk_text", F.round(F.col("dot") / F.col("qn"), 9).alias("score"))


def best(scored: DataFrame, key: Sequence[str], candidate: str, k: int = TOP_K) -> DataFrame:
    """The ``k`` best candidates of each key with their ``rank`` (equal scores: the smaller candidate); every task
    keeps ``k`` rows of a key at most before the rows of a key meet."""
    w = Window.partitionBy(*key).orderBy(F.col("score").desc(), F.col(candidate).asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unit_vectors(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Normalise an array<float> column to unit length once (S7), so search needs no norms."""
    norm = F.sqrt(F.aggregate(F.col(vec), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    out = df.withColumn("_norm", norm)  # a column, so the lambda does not recompute it per element
    return out.withColumn(vec, F.transform(F.col(vec), lambda x: (x.cast("double") / F.col("_norm")).cast("float"))) \
        .drop("_norm")


def vector_norms(df: DataFrame, vec: str = "embedding") -> DataFrame:
    return df.withColumn("norm", F.sqrt(F.aggregate(F.col(vec), F.lit(0.0),
                                                    lambda acc, x: acc + x.cast("double") * x.cast("double"))))


# ------------------------------------------------------------------ R4: exact top-k
def topk_inner_product(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, exclude_self: bool = False) -> DataFrame:
    """For every row of ``queries`` the k rows of ``corpus`` with the largest inner product; both are tables of any size.

    ``queries``: (query_id long, embedding); ``corpus``: (id long, doc string, embedding).  Output (query_id, rank, cand_id,
    cand_doc, score); fewer than k rows when the corpus is smaller.  ``exclude_self`` skips a candidate whose id is the
    query's.  A caller with several query tables builds the index once and calls ``vector_index.search``.
    """
    from kestrel.operators import vector_index

    return vector_index.search(vector_index.build(corpus), queries, k, exclude_self).drop("cell")


# ------------------------------------------------------------------ R5-R8
def groundedness(queries: DataFrame, topk: DataFrame, threshold: float = GROUNDEDNESS_THRESHOLD) -> DataFrame:
    """Top score >= threshold; a query with nothing retrieved has top score 0.0."""
    top1 = topk.where(F.col("rank") == 1).select("query_id", F.col("score").alias("top"))
    j = queries.select("query_id").join(top1, "query_id", "left")
    top = F.coalesce(F.col("top"), F.lit(0.0))
    return j.select("query_id", F.round(top, 4).alias("top_score"), (top >= threshold).alias("grounded"))


def retrieved_documents(topk: DataFrame) -> DataFrame:
    """Retrieved chunks mapped to documents, repeats dropped (first rank kept)."""
    return topk.groupBy("query_id", F.col("cand_doc").alias("doc_id")).agg(F.min("rank").alias("first_rank"))


def precision_recall(queries: DataFrame, topk: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per query, hits / distinct retrieved docs and hits / relevant docs; 0 when empty; 4 dp.

    ``relevant``: (query_id, doc_id) one row per relevant document.
    """
    docs = retrieved_documents(topk)
    rel = relevant.select("query_id", "doc_id").distinct().withColumn("_rel", F.lit(1))
    hits = docs.join(rel, ["query_id", "doc_id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_retrieved"), F.count("_rel").alias("n_hits"))
    n_rel = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    j = queries.select("query_id").join(hits, "query_id", "left").join(n_rel, "query_id", "left").fillna(
        0, ["n_retrieved", "n_hits", "n_relevant"])
    div = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))
    return j.select("query_id", "n_retrieved", "n_hits", "n_relevant",
                    F.round(div("n_hits", "n_retrieved"), 4).alias("precision_at_k"),
                    F.round(div("n_hits", "n_relevant"), 4).alias("recall_at_k"))


def macro_average(per_query: DataFrame) -> DataFrame:
    """Mean of the already rounded per-query values, 4 dp (in whole ten-thousandths, so that no order of adding
    decides a half)."""
    n = F.count(F.lit(1))

    def mean(c):
        total = F.sum(F.round(F.col(c) * 10000).cast("long"))
        return (F.floor((2 * total + n) / (2 * n)) / 10000.0).alias(f"avg_{c}")

    return per_query.agg(n.alias("n_queries"), mean("precision_at_k"), mean("recall_at_k"))
