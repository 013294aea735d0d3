"""The stages of the corpus pipeline; each calls one operator with its production parameters.

``(spark, docs, sf_dir)`` to a DataFrame: all but the last return the columns of ``docs`` as they came, row by row;
what a stage decides (rows dropped, lines taken out) is what the next one reads.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.bpe import encode_documents, read_ranks
from kestrel.llm.decontam import clean_documents
from kestrel.llm.langid import UNKNOWN, fit, predict, remainder
from kestrel.llm.lines import deduped
from kestrel.llm.queries import ranks_path, table
from kestrel.llm.shared import without, written
from kestrel.llm.simhash import near_duplicates

MIN_SCORE = 0.5  # of the predicted language: without a majority, the language is not known
MIN_KNOWN = 0.5  # share of the letters in known words and n-grams: below it, no learned language is evident


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters, without a majority language, or whose letters are mostly in no
    word or n-gram of any learned language go."""
    model = fit(docs.filter(remainder(F.col("doc_id")) != 1))
    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]  # by place, so that no name clashes
    known = predict(docs.toDF(*names), model, tuple(names)).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE) & (F.col("known") >= MIN_KNOWN))
    return known.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the repeats of cross-site lines; ``n_chars`` follows the text."""
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast("bigint")}
    return deduped(docs).select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group (one row of it, if it is repeated)."""
    # a row's key is its id and text: rows with one id and different texts are different documents
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("key_id"), F.xxhash64("text").alias("key_text"))
    rows = keyed.select(F.struct("key_id", "key_text").alias("doc_id"), F.col("row.text").alias("text"))
    groups = written(near_duplicates(rows).select("doc_id", "component_id"), "near-duplicate-groups")
    gone = groups.filter("doc_id <> component_id or not doc_id <=> component_id")
    kept = without(keyed, gone.select(F.col("doc_id.key_id").alias("gone_key_id"), F.col("doc_id.key_text").alias("gone_key_text")), "near-duplicates")
    repeated = written(groups.filter("doc_id <=> component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-rows")
    if not repeated.isEmpty():  # of repeated rows the smallest stays
        key = F.struct("key_id", "key_text")
        ones = kept.join(repeated, key.eqNullSafe(F.col("doc_id")), "left_semi").groupBy("key_id", "key_text").agg(F.min("row").alias("row"))
        kept = kept.join(repeated, key.eqNullSafe(F.col("doc_id")), "left_anti").select("row").unionByName(ones.select("row"))
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the kept documents (the last stage)."""
    return encode_documents(docs, read_ranks(ranks_path()), with_ids=True)
