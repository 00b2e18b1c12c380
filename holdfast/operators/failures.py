"""Failure breakdowns, turn-wise collapse and first-failure tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import fixed_values as fx
from holdfast.operators.common import grid, one_row, rate


def failure_rates(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """failed / total / rate over scored cells for any grouping."""
    table = counts.groupBy(*keys).agg(
        F.sum("failed").alias("failed"), (F.sum("failed") + F.sum("passed")).alias("total")
    )
    return table.filter(F.col("total") > 0).withColumn("failure_rate", rate("failed", "total"))


def category_failure_grid(
    final_counts: DataFrame, rule_types: Sequence[str] = tuple(fx.RULE_TYPES)
) -> DataFrame:
    """Final-turn failure rate by attack and rule type, with zero rows filled in."""
    keys = ["attack_intensity", "rule_type"]
    full = grid(one_row(final_counts), attack_intensity=fx.ATTACK_INTENSITIES, rule_type=rule_types)
    table = full.join(failure_rates(final_counts, keys).drop("failure_rate"), keys, "left")
    return table.fillna(0, subset=["failed", "total"]).withColumn(
        "failure_rate", rate("failed", "total")
    )


def failed_rule_counts(final_counts: DataFrame) -> DataFrame:
    """How many strictly failed records failed each rule on the final turn."""
    return (
        final_counts.filter(F.col("failed") > 0)
        .groupBy("rule_id", "rule_type")
        .agg(F.count(F.lit(1)).alias("records"))
    )


def target_failed_rule_matrix(
    final_counts: DataFrame, record_key: Sequence[str], rules: Sequence[tuple[str, str]]
) -> DataFrame:
    """Attacked rule x failed rule over strictly failed adversarial records.

    ``final_counts`` has one row per (record, rule) of the final turn and that turn's
    ``attack_targets``.  A repeated target counts as often as it is listed.
    """
    ids = [r for r, _ in rules]
    failed = (
        final_counts.filter((F.col("attack_intensity") == "adversarial") & (F.col("failed") > 0))
        .groupBy(*record_key, "attack_targets")
        .agg(*[F.max((F.col("rule_id") == r).cast("int")).alias(r) for r in ids])
    )
    by_target = (
        failed.withColumn("attack_target_rule_id", F.explode("attack_targets"))
        .filter(F.col("attack_target_rule_id").isin(ids))
        .groupBy("attack_target_rule_id")
        .agg(F.count(F.lit(1)).alias("records_with_target"), *[F.sum(r).alias(r) for r in ids])
    )
    types = F.create_map(*[F.lit(v) for pair in rules for v in pair])
    return by_target.unpivot(
        ["attack_target_rule_id", "records_with_target"], ids, "failed_rule_id", "failed_count"
    ).select(
        "attack_target_rule_id",
        types[F.col("attack_target_rule_id")].alias("attack_target_type"),
        "records_with_target",
        "failed_rule_id",
        types[F.col("failed_rule_id")].alias("failed_rule_type"),
        "failed_count",
        rate("failed_count", "records_with_target").alias("failed_rate"),
    )


FIRST_FAILURE_QUANTILES = {
    "median_first_failure_turn": 0.5,
    "p25_first_failure_turn": 0.25,
    "p75_first_failure_turn": 0.75,
}


def first_failure_summary(firsts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trajectories, failures and the distribution of the first failed turn.

    Exact percentiles run over (turn, count) pairs, so a group's memory depends on
    the number of distinct turns only.
    """
    per_turn = firsts.groupBy(*keys, "first_failure_turn").agg(F.count(F.lit(1)).alias("_n"))
    turn, n = F.col("first_failure_turn"), F.col("_n")
    failed = F.sum(F.when(turn.isNotNull(), n))
    return (
        per_turn.groupBy(*keys)
        .agg(
            F.sum(n).alias("trajectories"),
            F.coalesce(failed, F.lit(0)).alias("failed_trajectories"),
            F.try_divide(F.sum(turn * n), failed).alias("mean_first_failure_turn"),
            *[
                F.percentile(turn, F.lit(q), n).alias(name)
                for name, q in FIRST_FAILURE_QUANTILES.items()
            ],
            F.min(turn).alias("min_first_failure_turn"),
            F.max(turn).alias("max_first_failure_turn"),
        )
        .withColumn("failure_rate", rate("failed_trajectories", "trajectories"))
    )


def first_failure_grid(
    firsts: DataFrame, key: str, members: Sequence[str],
    attacks: Sequence[str] = tuple(fx.ATTACK_INTENSITIES),
) -> DataFrame:
    """First failures by attack and rule (or type) with zero rows for missing members."""
    keys = ["attack_intensity", key]
    table = firsts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trajectories"),
        F.count("first_failure_turn").alias("failed"),
        F.avg("first_failure_turn").alias("mean_first_turn"),
    )
    full = grid(one_row(firsts), **{"attack_intensity": attacks, key: members})
    filled = full.join(table, keys, "left").fillna(0, subset=["trajectories", "failed"])
    return filled.withColumn(
        "failure_rate_pct",
        F.coalesce(F.try_divide(F.col("failed") * 100.0, F.col("trajectories")), F.lit(0.0)),
    )
