"""Final-turn condition tables, grids, thresholds and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import fixed_values as fx
from holdfast.functions import labels as lb
from holdfast.operators.common import grid, metric_stats, one_row, rate, stat


def condition_table(
    finals: DataFrame,
    keys: Sequence[str] = ("temperature", "rule_count", "turn_count", "attack_intensity"),
) -> DataFrame:
    """Mean, std and n of the four final-turn metrics with the gap in points."""
    return finals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *metric_stats(),
        ((F.avg("per_rule_pass_rate") - F.avg("perfect_success")) * 100).alias("gap_pp"),
    )


def complete_grid(
    table: DataFrame, anchor: DataFrame | None = None, anchor_keys: Sequence[str] = (),
    counts: Sequence[str] = tuple(f"{m}_n" for m in fx.METRICS), **levels: Sequence[object],
) -> DataFrame:
    """Every cell of a fixed grid; missing cells get null measures and zero counts."""
    full = grid(one_row(table) if anchor is None else anchor, **levels)
    filled = full.join(table, [*anchor_keys, *levels], "left")
    return filled.fillna(0, subset=list(counts))


def condition_grid(
    finals: DataFrame, rule_counts: Sequence[int] = tuple(fx.RULE_COUNTS),
    turn_counts: Sequence[int] = tuple(fx.TURN_COUNTS),
) -> DataFrame:
    keys = ["rule_count", "turn_count", "attack_intensity"]
    table = finals.groupBy(*keys).agg(*metric_stats())
    return complete_grid(
        table, rule_count=rule_counts, turn_count=turn_counts,
        attack_intensity=fx.ATTACK_INTENSITIES,
    )


def target_rule_grid(
    finals: DataFrame, rule_counts: Sequence[int] = tuple(fx.RULE_COUNTS),
    turn_counts: Sequence[int] = tuple(fx.TURN_COUNTS),
) -> DataFrame:
    keys = ["target_rule_id", "rule_count", "turn_count", "attack_intensity"]
    table = finals.groupBy(*keys).agg(*metric_stats())
    targets = finals.filter(F.col("target_rule_id") != "").select("target_rule_id").distinct()
    return complete_grid(
        table, targets, ["target_rule_id"], rule_count=rule_counts, turn_count=turn_counts,
        attack_intensity=fx.ATTACK_INTENSITIES,
    )


def attack_order_table(finals: DataFrame) -> DataFrame:
    """Adversarial final turns by order variant; only known variants."""
    known = finals.filter(
        (F.col("attack_intensity") == "adversarial")
        & F.col("attack_order_variant").isin(fx.REPORTED_ORDER_VARIANTS)
    )
    return known.groupBy("rule_count", "turn_count", "attack_order_variant").agg(*metric_stats())


def final_cell_stats(finals: DataFrame) -> DataFrame:
    return finals.groupBy("attack_intensity", "rule_count", "turn_count").agg(
        *stat("per_rule_pass_rate", "compliance_rate")
    )


def rule_type_pass_rates(cells: DataFrame) -> DataFrame:
    """All-turn pass rate by rule type; records without rule metadata are left out."""
    known = cells.filter(F.col("has_rules") & F.col("pass").isNotNull())
    return known.groupBy("attack_intensity", "turn_count", "rule_type").agg(
        F.avg(F.col("pass").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n")
    )


def threshold_detection(
    turns: DataFrame, keys: Sequence[str], onset: float = 0.8, critical: float = 0.5
) -> DataFrame:
    """Mean first turn below the two limits, per rule count and attack."""
    below = turns.groupBy(*keys, "rule_count", "attack_intensity").agg(
        F.min(F.when(F.col("per_rule_pass_rate") < onset, F.col("turn"))).alias("_onset"),
        F.min(F.when(F.col("per_rule_pass_rate") < critical, F.col("turn"))).alias("_critical"),
    )
    return below.groupBy("rule_count", "attack_intensity").agg(
        F.avg("_onset").alias("onset_mean_turn"),
        F.count("_onset").alias("onset_n"),
        F.avg("_critical").alias("critical_mean_turn"),
        F.count("_critical").alias("critical_n"),
    )


def _mean_where(attack: str, metric: str):
    return F.avg(F.when(F.col("attack_intensity") == attack, F.col(metric)))


def overall_gap(finals: DataFrame) -> DataFrame:
    """Benign minus adversarial final-turn mean over all records, in points."""
    benign = _mean_where("benign", "per_rule_pass_rate")
    adversarial = _mean_where("adversarial", "per_rule_pass_rate")
    return finals.agg(
        benign.alias("benign_mean"),
        adversarial.alias("adversarial_mean"),
        ((benign - adversarial) * 100).alias("gap_pp"),
    )


def gap_cells(finals: DataFrame) -> DataFrame:
    """Strict-success gap per rules x turns cell that has both sides."""
    benign = _mean_where("benign", "perfect_success")
    adversarial = _mean_where("adversarial", "perfect_success")
    return (
        finals.groupBy("rule_count", "turn_count")
        .agg(((benign - adversarial) * 100).alias("gap_pp"))
        .filter(F.col("gap_pp").isNotNull())
    )


def gap_matrix(finals: DataFrame, turn_counts: Sequence[int] = tuple(fx.TURN_COUNTS)) -> DataFrame:
    """``gap_cells`` as a matrix: one row per rule count, one column per turn count."""
    return gap_cells(finals).groupBy("rule_count").agg(
        *[
            F.max(F.when(F.col("turn_count") == t, F.col("gap_pp"))).alias(f"t{t:02d}")
            for t in turn_counts
        ]
    )


def headline_summary(finals: DataFrame) -> DataFrame:
    """Unweighted means of cell means by attack and the mean shared-cell gap."""
    cells = finals.groupBy("rule_count", "turn_count").agg(
        _mean_where("benign", "perfect_success").alias("b"),
        _mean_where("adversarial", "perfect_success").alias("a"),
        _mean_where("adversarial", "targeted_rule_success").alias("t"),
        _mean_where("adversarial", "non_target_failure").alias("x"),
    )
    return cells.agg(
        F.avg("b").alias("mean_benign_perfect_success"),
        F.avg("a").alias("mean_adversarial_perfect_success"),
        F.avg("t").alias("mean_adversarial_targeted_rule_success"),
        F.avg("x").alias("mean_adversarial_non_target_failure"),
        F.avg(F.col("b") - F.col("a")).alias("mean_benign_minus_adversarial_gap"),
    )


def order_variant_means(finals: DataFrame) -> DataFrame:
    """Mean of the cell means of the two multi-turn attack orders."""
    table = attack_order_table(finals).filter(
        F.col("attack_order_variant").isin(list(fx.ORDER_VARIANTS))
    )
    return table.groupBy("attack_order_variant").agg(
        F.avg("per_rule_pass_rate_mean").alias("per_rule_pass_rate_mean"),
        F.count(F.lit(1)).alias("cells"),
    )


def metric_of_cell(table: DataFrame, rule_count: int, turn_count: int, attack: str) -> DataFrame:
    """The published row of one condition."""
    return table.filter(
        (F.col("rule_count") == rule_count)
        & (F.col("turn_count") == turn_count)
        & (F.col("attack_intensity") == attack)
    )


def longest_adversarial_appendix(target_table: DataFrame, turn_count: int) -> DataFrame:
    """Adversarial rows of the longest horizon by target rule."""
    return target_table.filter(
        (F.col("attack_intensity") == "adversarial") & (F.col("turn_count") == turn_count)
    ).select(
        "target_rule_id", "rule_count", "perfect_success_n", "perfect_success_mean",
        "targeted_rule_success_mean", "non_target_failure_mean",
    )


def before_after(before: DataFrame, after: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Two condition tables side by side, e.g. before and after an audit."""
    old = before.select(*keys, *[F.col(f"{m}_mean").alias(f"{m}_before") for m in metrics])
    new = after.select(*keys, *[F.col(f"{m}_mean").alias(f"{m}_after") for m in metrics])
    return old.join(new, list(keys), "full_outer")


def rule_failure_table(final_counts: DataFrame) -> DataFrame:
    """Final-turn failed / total / rate per rule and condition."""
    keys = ["rule_id", "rule_count", "turn_count", "attack_intensity"]
    table = final_counts.groupBy(*keys).agg(
        F.sum("failed").alias("failed"), (F.sum("failed") + F.sum("passed")).alias("total")
    )
    return table.filter(F.col("total") > 0).withColumn("failure_rate", rate("failed", "total"))


def published_order(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stable total order at write time; rule ids sort by number."""
    order = []
    for key in keys:
        order += lb.natural_rule_order(key) if key.endswith("rule_id") else [F.col(key)]
    return table.orderBy(*order)
