"""The registered queries of the operators, with production parameters over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kestrel.llm.cover import hard_negatives_sql
from kestrel.llm.lines import dedup_sql
from kestrel.llm.merkle import manifest_sql
from kestrel.llm.quality import judge_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.bpe import encode_documents, read_ranks

    return encode_documents(table(spark, sf_dir, "documents"), read_ranks(ranks_path()))


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


@query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), links=True)


@query("op1_quality_rules", judge_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"))


@query("op9_line_dedup", dedup_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from kestrel.llm.lines import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kestrel.llm.unigram import count_tokens, read_pieces

    return count_tokens(table(spark, sf_dir, "documents"), read_pieces(public_tokenizers.path("piece_bpe_32k.model")))


@query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages"))


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.licenses import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


@query("op13_merkle_manifest", manifest_sql(12))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


@query("op11_quality_classifier")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.fm import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_hard_negatives", hard_negatives_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm.cover import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))
