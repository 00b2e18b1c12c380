"""Run profiles, drilldowns, representative picks and other report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.operators.common import first_per_key


def counts_by(df: DataFrame, dimensions: Sequence[str | tuple[str, ...]]) -> DataFrame:
    """Row counts for several dimensions (or pairs) in one pass.

    Returns ``dimension, value, n``; pairs are joined with ``|``.
    """
    sets = [(d,) if isinstance(d, str) else tuple(d) for d in dimensions]
    names = list(dict.fromkeys(c for s in sets for c in s))
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names])
    counted = text.groupingSets([list(s) for s in sets], *names).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_set")
    )

    def set_id(members: tuple[str, ...]) -> int:
        return sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in members)

    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for members in sets:
        here = F.col("_set") == set_id(members)
        dimension = F.when(here, F.lit("|".join(members))).otherwise(dimension)
        value = F.when(here, F.concat_ws("|", *members)).otherwise(value)
    return counted.select(dimension.alias("dimension"), value.alias("value"), "n")


def attack_target_drilldown(
    final_counts: DataFrame, record_key: Sequence[str], rule_types: Mapping[str, str]
) -> DataFrame:
    """Did the attacked rule survive the final turn?  One count per listed target."""
    scored = F.col("passed") + F.col("failed")
    totals = final_counts.filter(F.col("attack_intensity") == "adversarial").groupBy(
        *record_key, "temperature", "attack_targets"
    ).agg(
        F.sum("passed").alias("_p"),
        F.sum(scored).alias("_s"),
        *[
            F.max(F.when((F.col("rule_id") == r) & (scored > 0), (F.col("failed") == 0).cast("int"))).alias(f"_{r}")
            for r in rule_types
        ],
    )
    state = F.lit(None).cast("int")
    for r in rule_types:
        state = F.when(F.col("target") == r, F.col(f"_{r}")).otherwise(state)
    rows = (
        totals.withColumn("target", F.explode("attack_targets"))
        .filter(F.col("target") != "")
        .withColumn("ok", state)
        .withColumn("old", F.coalesce(F.try_divide("_p", "_s"), F.lit(1.0)))
        .withColumn("strict", (F.col("_p") == F.col("_s")).cast("double"))
    )
    known = F.col("ok").isNotNull()
    types = F.create_map(*[F.lit(v) for pair in rule_types.items() for v in pair])
    return rows.groupBy("temperature", F.col("target").alias("attack_target_rule_id")).agg(
        F.count("ok").alias("scorable_n"),
        F.count_if(~known).alias("not_scorable_targets"),
        F.avg(F.when(known, F.col("old"))).alias("old_per_rule_mean"),
        F.avg(F.when(known, F.col("strict"))).alias("perfect_success_mean"),
        F.avg("ok").alias("attacked_rule_success_mean"),
        F.count_if(F.col("ok") == 0).alias("target_failed"),
        F.count_if((F.col("ok") == 1) & (F.col("strict") < 1)).alias("target_survived_other_failed"),
        F.count_if((F.col("ok") == 1) & (F.col("strict") == 1)).alias("all_rules_passed"),
    ).withColumn(
        "attack_target_type",
        F.coalesce(F.try_element_at(types, F.col("attack_target_rule_id")), F.lit("unknown")),
    )


def null_kinds(method: str = "method") -> list[Column]:
    """Unscored cells: not applicable by their detail text, or still open."""
    detail = F.lower(F.coalesce(F.col("detail"), F.lit("")))
    na = detail.contains("not applicable") | detail.contains("해당 없음")
    empty = F.col("pass").isNull()
    return [
        F.count_if(empty & na).alias("none_not_applicable"),
        F.count_if(empty & ~na).alias("none_unresolved"),
    ]


def method_outcomes(cells: DataFrame) -> DataFrame:
    """Cells by scoring method and outcome, with the two kinds of missing scores."""
    outcome = F.when(F.col("pass"), "pass").when(~F.col("pass"), "fail").otherwise("na")
    method = F.coalesce(F.col("method"), F.lit("unknown"))
    return cells.groupBy(method.alias("method"), outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("cells"), *null_kinds()
    )


def repetition_profile(records: DataFrame) -> DataFrame:
    """How many cases have how many distinct repetitions."""
    per_case = records.groupBy("case_id").agg(F.count_distinct("rep").alias("reps"))
    return per_case.groupBy("reps").agg(F.count(F.lit(1)).alias("cases"))


def error_responses(turns: DataFrame, response: str = "response") -> DataFrame:
    return turns.agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if(F.col(response).startswith("[ERROR]")).alias("error_responses"),
    )


def bucket_composition(records: DataFrame, rule_set: str = "rule_set") -> DataFrame:
    """Which rule sets make up each attack x rules x turns cell, and how often."""
    return records.groupBy("attack_intensity", "rule_count", "turn_count", rule_set).agg(
        F.count_distinct("case_id").alias("cases"),
        F.count(F.lit(1)).alias("runs"),
        F.count_distinct("rep").alias("reps"),
    )


def representative_runs(finals: DataFrame, metric: str = "per_rule_pass_rate") -> DataFrame:
    """The run nearest to its cell's mean; ties by case id, then repetition.

    The cell mean is joined back (one row per cell) instead of held in a window, so
    a cell with a large share of all runs is not gathered in one task.
    """
    cell = ["attack_intensity", "rule_count", "turn_count"]
    means = finals.groupBy(*cell).agg(
        F.avg(metric).alias("cell_mean"), F.count(F.lit(1)).alias("cell_n")
    )
    gap = F.round(F.abs(F.col(metric) - F.col("cell_mean")), 9)
    return first_per_key(
        finals.join(means, cell), cell, [gap, F.col("case_id"), F.col("rep")]
    )


def showcase_runs(
    finals: DataFrame, firsts: DataFrame, specs: Sequence[Mapping[str, object]], key: Sequence[str]
) -> DataFrame:
    """One run per wanted cell: the preferred id, else in-range first failure,
    earliest failure, widest partial-minus-strict gap, case id, repetition."""
    rows = finals.join(firsts, list(key), "left")
    wanted = F.array(
        *[
            F.struct(
                F.lit(s["name"]).alias("showcase"),
                F.lit(s["attack"]).alias("attack"),
                F.lit(s["rule_count"]).alias("rules"),
                F.lit(s["turn_count"]).alias("turns"),
                F.lit(s["first_failure_min"]).alias("low"),
                F.lit(s["first_failure_max"]).alias("high"),
                F.lit(s.get("preferred_case_id")).cast("string").alias("preferred"),
                F.lit(s.get("preferred_rep")).cast("int").alias("preferred_rep"),
            )
            for s in specs
        ]
    )
    s = F.col("_spec")
    preferred = (F.col("case_id").cast("string") == s["preferred"]) & (F.col("rep") == s["preferred_rep"])
    in_cell = (
        (F.col("attack_intensity") == s["attack"])
        & (F.col("rule_count") == s["rules"])
        & (F.col("turn_count") == s["turns"])
    )
    first = F.coalesce(F.col("first_failure_turn"), F.lit(999))
    candidates = rows.withColumn("_spec", F.explode(wanted)).filter(
        F.coalesce(preferred, F.lit(False)) | in_cell
    )
    order = [
        F.coalesce(preferred, F.lit(False)).desc(),
        first.between(s["low"], s["high"]).desc(),
        first,
        (F.col("per_rule_pass_rate") - F.col("perfect_success")).desc(),
        F.col("case_id"),
        F.col("rep"),
    ]
    picked = first_per_key(candidates.withColumn("showcase", s["showcase"]), ["showcase"], order)
    return picked.drop("_spec")


def largest_run(records: DataFrame) -> DataFrame:
    """Largest rules x turns run among hard adversarial ones, else any long run."""
    hard = (
        (F.col("rule_count") >= 5)
        & (F.col("attack_intensity") == "adversarial")
        & (F.col("turn_count") >= 10)
    )
    tier = F.when(hard, 0).when(F.col("turn_count") >= 5, 1)
    return (
        records.withColumn("_tier", tier)
        .filter(F.col("_tier").isNotNull())
        .orderBy("_tier", (F.col("rule_count") * F.col("turn_count")).desc(), "case_id", "rep")
        .limit(1)
        .drop("_tier")
    )


def scope_check(records: DataFrame, expected: Sequence[str], member: str = "target_rule_id") -> DataFrame:
    """Members present against an expected list, with a balance flag.

    ``status``: present, missing (expected only) or extra (found only).
    """
    found = records.filter(F.col(member) != "").groupBy(member).agg(F.count(F.lit(1)).alias("records"))
    listed = records.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(e) for e in expected])).alias(member), F.lit(True).alias("_listed")
    )
    joined = found.join(listed, member, "full_outer")
    # One row per distinct member: the window only sees the member list.
    everyone = Window.partitionBy(F.lit(1))
    balanced = F.min("records").over(everyone) == F.max("records").over(everyone)
    status = (
        F.when(F.col("records").isNull(), F.lit("missing"))
        .when(F.col("_listed").isNull(), F.lit("extra"))
        .otherwise(F.lit("present"))
    )
    return joined.select(
        member, F.coalesce(F.col("records"), F.lit(0)).alias("records"), status.alias("status"),
        balanced.alias("balanced"),
    )


def design_trace_counts(cases: DataFrame) -> DataFrame:
    """Case counts over the seven provenance dimensions."""
    return counts_by(
        cases,
        [
            "condition", "rule_count", "turn_count", "attack_order_variant",
            "sampled_variant_id", "possible_variant_id", "active_rule_ids",
        ],
    )
