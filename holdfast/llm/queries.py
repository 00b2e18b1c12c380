"""The training-data queries ``opN_name`` over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import (
    exact_dedup, fingerprints, html_text, kd_shards, language_id, mixing, near_dedup, packing, prefix_trie, quality, secret_scan,
    sql, token_counts, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(sql.ORACLES)


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    """Packing with the production tokenizer."""
    encoder = packing.file_encoder(_tokenizer("byte_bpe_50k.tiktoken"), _tokenizer("byte_bpe_50k.json"))
    return packing.pack(docs, encoder)


@_query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_documents(spark, sf_dir))


@_query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.resolve(_documents(spark, sf_dir))


@_query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.count_tokens(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))
    return rows.withColumn("over_limit", F.col("n_tokens") > 512)


@_query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


@_query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_documents(spark, sf_dir))


@_query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir))


@_query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "source"
    )


@_query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(_documents(spark, sf_dir))


@_query
def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kd_shards.assign(_documents(spark, sf_dir), shards=16)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(_documents(spark, sf_dir))


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
