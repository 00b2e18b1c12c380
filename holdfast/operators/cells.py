"""Score cells -> turns -> records: the grain changes everything else is built on.

A cells table has the record key, the record's attributes, ``turn``, ``rule_id``,
``pass`` (true / false / null), ``method``, ``detail`` and the two flags
``is_target`` / ``any_target`` (see ``with_target_flags``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import fixed_values as fx
from holdfast.functions import labels as lb
from holdfast.functions import metrics as mt
from holdfast.operators.common import RECORD_KEY


def explode_turns(records: DataFrame, turns: str = "turn_results") -> DataFrame:
    """Nested run records -> one row per turn."""
    keep = [c for c in records.columns if c != turns]
    return records.select(*keep, F.explode(turns).alias("_t")).select(*keep, "_t.*")


def explode_cells(turns: DataFrame, scores: str = "scores") -> DataFrame:
    """Turns -> score cells; ``score_index`` is the position in the turn's list."""
    keep = [c for c in turns.columns if c != scores]
    return turns.select(*keep, F.posexplode(scores).alias("score_index", "_s")).select(
        *keep, "score_index", "_s.*"
    )


def with_target_flags(cells: DataFrame, targets: str = "attack_targets") -> DataFrame:
    return cells.withColumns(
        {
            "is_target": mt.is_target(targets, "rule_id"),
            "any_target": mt.has_targets(targets),
        }
    )


def turn_metrics(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The four metrics for every turn, in one map-side combined aggregate."""
    return cells.groupBy(*keys).agg(*mt.grouped_metrics("pass", "is_target", "any_target"))


def turn_metrics_nested(
    turns: DataFrame, scores: str = "scores", targets: str = "attack_targets"
) -> DataFrame:
    """The four metrics where the cells are still an array: no shuffle."""
    keep = [c for c in turns.columns if c not in fx.METRICS]
    return turns.withColumn("_m", mt.array_metrics(scores, targets)).select(*keep, "_m.*")


def final_turn(
    turns: DataFrame, keys: Sequence[str], values: Sequence[str] = fx.METRICS
) -> DataFrame:
    """The highest turn of every record with its values."""
    return turns.groupBy(*keys).agg(
        *[F.max_by(v, "turn").alias(v) for v in values], F.max("turn").alias("turn")
    )


def outcome_counts(prefix: str = "") -> list[Column]:
    passed = F.col("pass")
    return [
        F.count_if(passed).alias(f"{prefix}passed"),
        F.count_if(~passed).alias(f"{prefix}failed"),
        F.count_if(passed.isNull()).alias(f"{prefix}na"),
    ]


def cell_counts(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """passed / failed / na counts; bounds a hot record to turns x rules rows."""
    return cells.groupBy(*keys).agg(*outcome_counts())


def on_final_turn(counts: DataFrame, record_key: Sequence[str] = ("case_id",)) -> DataFrame:
    """Keep the rows of each record's highest turn.

    Meant for pre-counted cells: a record then holds at most turns x rules rows.
    """
    last = F.max("turn").over(Window.partitionBy(*record_key))
    return (
        counts.withColumn("_last", last).filter(F.col("turn") == F.col("_last")).drop("_last")
    )


def first_failures(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First failed turn per (record, rule); kept after a recovery.

    Only pairs with at least one scored cell are trajectories.
    """
    return (
        cells.filter(F.col("pass").isNotNull())
        .groupBy(*keys)
        .agg(F.min(F.when(~F.col("pass"), F.col("turn"))).alias("first_failure_turn"))
    )


def first_failed_turn(cells: DataFrame, keys: Sequence[str] = RECORD_KEY) -> DataFrame:
    """First turn of a record with any failed rule (null if none)."""
    return cells.groupBy(*keys).agg(
        F.min(F.when(~F.col("pass"), F.col("turn"))).alias("first_failure_turn")
    )


def first_turn_below(
    turns: DataFrame, keys: Sequence[str], limit: float, metric: str = "per_rule_pass_rate"
) -> DataFrame:
    return turns.groupBy(*keys).agg(
        F.min(F.when(F.col(metric) < limit, F.col("turn"))).alias("first_turn_below")
    )


def longest_horizon(rows: DataFrame) -> DataFrame:
    """Rows of the records with the largest planned turn count.

    The joined side is one aggregated row, so its broadcast cannot grow.
    """
    top = rows.agg(F.max("turn_count").alias("turn_count"))
    return rows.join(F.broadcast(top), "turn_count", "left_semi")


def unresolved_counts(cells: DataFrame, keys: Sequence[str] = RECORD_KEY) -> DataFrame:
    """Judge cells still without a verdict, per record, and the record's status."""
    open_cell = lb.is_unresolved("method", "pass", "detail")
    return cells.groupBy(*keys).agg(F.count_if(open_cell).alias("unresolved")).withColumn(
        "judge_status",
        F.when(F.col("unresolved") == 0, F.lit("complete")).otherwise(F.lit("incomplete")),
    )


def status_matrix(cells: DataFrame, rule_ids: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Turn x rule matrix of one record: 1 passed, 0 failed, 0.5 without a score.

    A rule that is not scored on a turn stays null.
    """
    ok = F.col("pass").cast("double")
    value = F.coalesce(ok, F.lit(0.5))
    return cells.groupBy(*keys, "turn").agg(
        *[F.min(F.when(F.col("rule_id") == r, value)).alias(r) for r in rule_ids]
    )
