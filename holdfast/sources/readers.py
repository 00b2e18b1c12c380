"""File scans.  Every JSON scan has a fixed schema; nothing is inferred."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast import schemas as sc
from holdfast.functions import labels as lb
from holdfast.functions.text import strip

LOG = logging.getLogger(__name__)
CORRUPT = "_corrupt_record"


def _file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system): works for local and cluster storage alike."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def matching_paths(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Paths that exist for the given paths or globs, sorted within each pattern."""
    found: list[str] = []
    for pattern in patterns:
        path, fs = _file_system(spark, pattern)
        found += sorted(str(s.getPath()) for s in (fs.globStatus(path) or []))
    return found


def preferred_paths(
    spark: SparkSession, preferred: str, fallback: str, given: Sequence[str] | None = None
) -> list[str]:
    """Explicit patterns, else the preferred glob, else the fallback glob."""
    if given:
        return matching_paths(spark, given)
    return matching_paths(spark, [preferred]) or matching_paths(spark, [fallback])


def ingest_order() -> Column:
    """Total order of the input rows: file, split offset, row inside the split.

    Valid on the scan itself only, before any shuffle.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_json_lines(
    spark: SparkSession, paths: Sequence[str] | str, schema: str, with_order: bool = False
) -> DataFrame:
    """JSON lines with a schema; unreadable lines are kept in ``_corrupt_record``.

    Blank lines give no row.
    """
    rows = (
        spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).json(paths)
    )
    return rows.withColumn("ingest_ord", ingest_order()) if with_order else rows


def good_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def quarantined(rows: DataFrame) -> DataFrame:
    """Lines that did not parse, of stored rows (``write_with_summary``): a scan of JSON cannot give these alone."""
    return rows.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A missing file gives an empty table and a warning."""
    if not matching_paths(spark, [path]):
        LOG.warning("no file at %s, using an empty table", path)
        return spark.createDataFrame([], schema)
    return good_rows(read_json_lines(spark, path, schema))


def read_run_records(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Run records with the temperature resolved and an ingest order."""
    rows = read_json_lines(spark, paths, sc.RUN_RECORD, with_order=True)
    return good_rows(rows).withColumn(
        "temperature", lb.temperature("temperature", "generation_config.temperature")
    )


def read_result_tree(spark: SparkSession, root: str, schema: str, file_name: str = "results.jsonl") -> DataFrame:
    """Every result file below ``root``; model and variant come from its folders."""
    rows = (
        spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", file_name).json(root)
    )
    path = F.col("_metadata.file_path")
    return rows.withColumns(
        {
            "variant_name": F.regexp_extract(path, r"([^/]+)/[^/]+$", 1),
            "model_name": F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1),
        }
    )


def read_cases(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    return good_rows(read_json_lines(spark, paths, sc.CASE))


def case_turns(cases: DataFrame) -> DataFrame:
    """(case_id, turn) metadata: targets, normalised mode, prompt and scenario ids."""
    turns = cases.select("case_id", F.explode("conversation_template").alias("_t")).select("case_id", "_t.*")
    mode = F.coalesce(F.nullif(F.col("attack_type"), F.lit("")), F.col("attack_mode"))
    return turns.select(
        "case_id", "turn", "attack_targets", lb.attack_mode(mode).alias("attack_mode"), "scenario_id", "prompt_id"
    )


def read_text_table(
    spark: SparkSession, paths: Sequence[str] | str, required: Sequence[str] = (), multi_line: bool = False
) -> DataFrame:
    """CSV with a header, all columns text, nulls as empty text.

    Large files are split over tasks; cells that hold line breaks need ``multi_line``,
    which makes one task of each file; without it such a cell is an error, not a torn row.  A byte-order mark on the first header name is removed; missing required columns
    are an error.
    """
    rows = (
        spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi_line)
        .option("escape", '"').option("mode", "PERMISSIVE" if multi_line else "FAILFAST").csv(paths)
    )
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    missing = sorted(set(required) - set(rows.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return rows.fillna("")


def _is(column: str, value: str) -> Column:
    return F.lower(strip(column)) == value


def read_attack_prompts(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Curated attack prompts without the rows marked invalid; ``level`` is an int."""
    rows = read_text_table(spark, path, sc.PROMPT_COLUMNS, multi_line)
    return rows.filter(~_is("is_valid_prompt", "no")).withColumn(
        "level", F.col("attack_strength_level").try_cast("int")
    )


def read_scenarios(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Single-turn scenarios marked for use, with the rule set as an array."""
    rows = read_text_table(spark, path, sc.SCENARIO_COLUMNS, multi_line)
    used = rows.filter(~_is("is_valid_prompt", "no") & _is("use_for_frontier_q2", "yes"))
    return used.withColumn(
        "rule_ids",
        F.filter(F.transform(F.split("system_rule_set", ","), lambda r: strip(r)), lambda r: r != ""),
    )


def read_chat_export(spark: SparkSession, path: str) -> DataFrame:
    """Small JSON arrays of conversations, a task for each file; ``json_array.read_json_array`` splits large ones."""
    return spark.read.schema(sc.CHAT_EXPORT).option("multiLine", True).json(path)


def read_benchmark_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversation benchmark; each row keeps its own source id and criteria."""
    rows = good_rows(read_json_lines(spark, path, sc.BENCHMARK_CONVERSATION))
    return rows.select(
        F.coalesce("QUESTION_ID", F.sha2(F.to_json("CONVERSATION"), 256)).alias("source_id"),
        F.col("AXIS").alias("axis"), F.col("CONVERSATION").alias("conversation"),
        F.col("TARGET_QUESTION").alias("target_question"), F.col("PASS_CRITERIA").alias("pass_criteria"),
    )


def read_instruction_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Instruction prompts; rows without a prompt or without ids are left out."""
    rows = good_rows(read_json_lines(spark, path, sc.INSTRUCTION_PROMPT, with_order=True))
    return rows.withColumnRenamed("instruction_id_list", "instruction_ids").filter(
        (F.coalesce(F.length("prompt"), F.lit(0)) > 0) & (F.coalesce(F.size("instruction_ids"), F.lit(0)) > 0)
    )


def read_suites(spark: SparkSession, root: str, suites: Sequence[str], scenarios: Sequence[str]) -> DataFrame:
    """``<root>/<suite>/<scenario>*.jsonl`` with suite and scenario from the path."""
    patterns = [f"{root}/{s}/{n}*.jsonl" for s in suites for n in scenarios]
    paths = matching_paths(spark, patterns)
    if not paths:
        return spark.createDataFrame([], f"{sc.SUITE_CASE}, suite string, scenario string, ingest_ord string")
    rows = good_rows(read_json_lines(spark, paths, sc.SUITE_CASE, with_order=True))
    path = F.col("ingest_ord.file")
    name = F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)
    scenario = F.lit(None).cast("string")
    for known in sorted(scenarios, key=len):
        scenario = F.when(name.startswith(known), F.lit(known)).otherwise(scenario)
    return rows.withColumns(
        {"suite": F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), "scenario": scenario}
    )


def read_request_records(spark: SparkSession, path: str) -> DataFrame:
    return good_rows(read_json_lines(spark, path, sc.REQUEST_RECORD, with_order=True))


def read_judge_checkpoints(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Sidecar verdicts flattened to slot key, score and order."""
    rows = good_rows(read_json_lines(spark, paths, sc.JUDGE_CHECKPOINT, with_order=True))
    return rows.select(
        "key.*", F.col("score.pass").alias("pass"), F.col("score.detail").alias("detail"), "timestamp", "ingest_ord"
    )
