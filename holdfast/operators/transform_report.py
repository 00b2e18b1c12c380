"""Report on context transforms: compliance, defence effect and size ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import labels as lb
from holdfast.operators.common import rate

BASE_METHODS = ["none", "sliding_window", "selective_context", "summarize_turns", "system_prompt_reinforce"]


def transform_report(scored: DataFrame) -> DataFrame:
    """n, compliant and rate for three groupings in one pass.

    Input columns: ``variant, turn_count, rule_count, token_length, compliant`` (0/1,
    null when the response had nothing to score; such rows count in ``unscored``).
    """
    sets = {
        "variant_turns": ["variant", "turn_count"],
        "rules_turns": ["rule_count", "turn_count"],
        "rules_tokens": ["rule_count", "token_length"],
    }
    names = ["variant", "turn_count", "rule_count", "token_length"]
    grouped = scored.groupingSets(list(sets.values()), *names).agg(
        F.count("compliant").alias("n"),
        F.count_if(F.col("compliant").isNull()).alias("unscored"),
        F.coalesce(F.sum("compliant"), F.lit(0)).alias("compliant"),
        F.grouping_id().alias("_set"),
    )
    label = F.lit(None).cast("string")
    for name, members in sets.items():
        bits = sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in members)
        label = F.when(F.col("_set") == bits, F.lit(name)).otherwise(label)
    return (
        grouped.withColumn("grouping", label)
        .drop("_set")
        .withColumn("compliance_rate", F.round(rate("compliant", "n"), 4))
    )


def variant_turn_rates(scored: DataFrame) -> DataFrame:
    return scored.groupBy("variant", "turn_count").agg(
        F.count("compliant").alias("n"),
        F.coalesce(F.sum("compliant"), F.lit(0)).alias("compliant"),
    ).withColumn("compliance_rate", F.round(rate("compliant", "n"), 4))


def defense_effect(rates: DataFrame, baseline: str = "none") -> DataFrame:
    """Each variant against the untransformed baseline of the same turn count."""
    base = rates.filter(F.col("variant") == baseline).select(
        "turn_count", F.col("compliance_rate").alias("baseline_rate")
    )
    joined = rates.filter(F.col("variant") != baseline).join(base, "turn_count", "left")
    b = F.coalesce(F.col("baseline_rate"), F.lit(0.0))
    c = F.col("compliance_rate")
    return joined.select(
        "variant", "turn_count", c, b.alias("baseline_rate"),
        F.round(F.when(b < 1.0, (c - b) / (1.0 - b)).otherwise(0.0), 4).alias("defense_effectiveness"),
        F.round(F.when(b > 0, F.try_divide(c, b)).otherwise(0.0), 4).alias("compliance_preservation"),
    )


def mean_ratios(scored: DataFrame, ratio: str = "compression_ratio") -> DataFrame:
    return scored.filter(F.col(ratio).isNotNull()).groupBy("variant").agg(
        F.round(F.avg(ratio), 4).alias("avg_compression_ratio"), F.count(ratio).alias("n")
    )


def method_rollup(rates: DataFrame, ratios: DataFrame) -> DataFrame:
    """Unweighted mean rate over turn counts against the size ratio, per variant."""
    means = rates.filter(F.col("variant") != "none").groupBy("variant").agg(
        F.avg("compliance_rate").alias("mean_compliance_rate")
    )
    return means.join(ratios.select("variant", "avg_compression_ratio"), "variant").withColumn(
        "method", lb.base_method("variant", BASE_METHODS)
    )


def rule_count_overall(scored: DataFrame) -> DataFrame:
    """Rate per rule count, weighted by the n of each turn count."""
    rates = scored.groupBy("rule_count", "turn_count").agg(
        F.count("compliant").alias("n"), F.round(F.avg("compliant"), 4).alias("r")
    )
    return rates.groupBy("rule_count").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum(F.col("r") * F.col("n")), F.sum("n")).alias("overall_rate")
    )
