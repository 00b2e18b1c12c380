"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, packing.

Every stage takes all rows that its predecessor kept.  All but the last return the
columns of ``documents``; the last returns pieces of packed sequences.  SQL cannot
express the cube draws, so there is no oracle; tests rebuild the rows by brute force.

Cases: null, empty and blank texts fail the quality rules; very long texts are taken whole
and packed in several pieces; of equal texts the longest original stays, ties go to the
smallest doc_id; repeated rows are copies of each other; rows without doc_id pass through
near-dedup unlinked; rows that share a doc_id are one document there; an empty table gives
no row at every stage; extra columns are carried along to the packing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import exact_dedup, mixing, near_dedup, quality
from holdfast.llm import queries as llm_queries
from holdfast.llm import shared as sh

NEAR = near_dedup.NearRules(words=5, percent=80)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, NEAR)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return llm_queries.packed(docs)


STAGES = [
    ("quality_rules", good_quality),
    ("exact_dedup", without_copies),
    ("minhash_near_dedup", without_near_copies),
    ("source_mixing", mixed_sources),
    ("packing", packed_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = sh.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
