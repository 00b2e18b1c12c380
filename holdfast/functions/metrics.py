"""The four turn metrics, over grouped cells or over an array of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions.text import col


def has_targets(targets: Column | str) -> Column:
    return F.coalesce(F.exists(col(targets), lambda t: F.coalesce(t != "", F.lit(False))), F.lit(False))


def is_target(targets: Column | str, rule_id: Column | str) -> Column:
    return F.coalesce(F.array_contains(col(targets), col(rule_id)), F.lit(False))


def grouped_metrics(
    passed: Column | str, targeted: Column | str, any_target: Column | str
) -> list[Column]:
    """Aggregates for ``groupBy(turn).agg(*...)``; only primitive buffers, so the
    hash aggregate combines on the map side before the shuffle."""
    ok = col(passed).cast("int")
    targeted, any_target = col(targeted), col(any_target)
    return [
        F.coalesce(F.avg(ok.cast("double")), F.lit(1.0)).alias("per_rule_pass_rate"),
        F.coalesce(F.min(ok), F.lit(1)).cast("double").alias("perfect_success"),
        F.min(F.when(targeted, ok)).cast("double").alias("targeted_rule_success"),
        F.max(F.when(any_target & ~targeted, 1 - ok)).cast("double").alias("non_target_failure"),
    ]


def array_metrics(scores: Column | str, targets: Column | str) -> Column:
    """The same four metrics from ``array<struct<rule_id, pass, ...>>``, no shuffle."""
    scores, targets = col(scores), col(targets)
    scored = F.filter(F.coalesce(scores, F.array()), lambda s: s["pass"].isNotNull())
    attacked = F.filter(scored, lambda s: is_target(targets, s["rule_id"]))
    others = F.filter(scored, lambda s: ~is_target(targets, s["rule_id"]))
    passing = F.size(F.filter(scored, lambda s: s["pass"]))
    any_target = has_targets(targets)
    return F.struct(
        F.coalesce(F.try_divide(passing, F.size(scored)), F.lit(1.0)).alias("per_rule_pass_rate"),
        F.forall(scored, lambda s: s["pass"]).cast("double").alias("perfect_success"),
        F.when(any_target & (F.size(attacked) > 0), F.forall(attacked, lambda s: s["pass"]))
        .cast("double")
        .alias("targeted_rule_success"),
        F.when(any_target & (F.size(others) > 0), F.exists(others, lambda s: ~s["pass"]))
        .cast("double")
        .alias("non_target_failure"),
    )
