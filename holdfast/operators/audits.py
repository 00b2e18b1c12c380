"""Human and policy audits of judge cells, and verdict merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import fixed_values as fx
from holdfast.functions import labels as lb
from holdfast.functions import rules as rl
from holdfast.functions import text as tx
from holdfast.operators.common import first_per_key

AUDIT_KEY = ["case_id", "turn", "rule_id"]


def normalize_labels(labels: DataFrame) -> DataFrame:
    """Human label rows to action / applicable / pass / reason.

    Adds ``label_status``, ``was_shifted`` and ``action_flag`` (``unsure`` rows keep
    the judge's score and are flagged).
    """
    raw_action = tx.strip(F.coalesce(F.col("human_action"), F.lit("")))
    raw_reason = tx.strip(F.coalesce(F.col("human_reason"), F.lit("")))
    rows = labels.withColumns(
        {
            "_action": raw_action,
            "_reason": raw_reason,
            "_applicable": lb.text_bool("human_applicable"),
            "_pass": lb.text_bool("human_pass"),
            "_judge": lb.text_bool("judge_pass"),
        }
    )
    shifted = ~F.col("_action").isin(fx.AUDIT_ACTIONS) & F.col("_reason").isin(fx.AUDIT_ACTIONS)
    explicit = (
        (F.col("_applicable") != "") | (F.col("_pass") != "")
        | (F.col("_action") != "") | (F.col("_reason") != "")
    )
    rows = rows.withColumns({"was_shifted": shifted, "_explicit": explicit}).withColumns(
        {
            "_a": F.when(F.col("was_shifted"), F.col("_reason")).otherwise(F.col("_action")),
            "_r": F.when(F.col("was_shifted"), F.col("_action")).otherwise(F.col("_reason")),
        }
    )
    inferred = F.when(
        (F.col("_a") == "") & F.col("_pass").isin("TRUE", "FALSE"),
        F.when(F.col("_pass") != F.col("_judge"), F.lit("override")).otherwise(F.lit("keep")),
    ).otherwise(F.col("_a"))
    rows = rows.withColumn("_a", inferred)
    excluded = (F.col("_a") == "exclude") | (F.col("_applicable") == "FALSE")
    action = F.when(excluded, F.lit("exclude")).otherwise(F.col("_a"))
    passed = (
        F.when(excluded, F.lit("NA"))
        .when((F.col("_a") == "keep") & (F.col("_pass") == ""), F.col("_judge"))
        .otherwise(F.col("_pass"))
    )
    applicable = (
        F.when(excluded & (F.col("_applicable") == ""), F.lit("FALSE"))
        .when((F.col("_a") == "override") & (F.col("_applicable") == ""), F.lit("TRUE"))
        .otherwise(F.col("_applicable"))
    )
    blank = ~F.col("_explicit")
    return rows.withColumns(
        {
            "label_status": F.when(blank, F.lit("inferred_keep_from_blank")).otherwise(
                F.lit("explicit_human_label")
            ),
            "action": F.when(blank, F.lit("keep")).otherwise(action),
            "applicable": F.when(blank, F.lit("TRUE")).otherwise(applicable),
            "human_pass_norm": F.when(blank, F.col("_judge")).otherwise(passed),
            "reason": F.when(
                blank, F.lit("blank human fields interpreted as judge accepted")
            ).otherwise(F.col("_r")),
            "action_flag": F.when(F.col("_a") == "unsure", F.lit("unsure")),
        }
    ).drop("_action", "_reason", "_applicable", "_pass", "_judge", "_explicit", "_a", "_r")


def merge_labels(labels: DataFrame, order: str, key: str = "review_id") -> DataFrame:
    """One label per review id: the later file wins."""
    named = labels.filter(F.coalesce(F.col(key) != "", F.lit(False)))
    return first_per_key(named, [key], [F.col(order).desc()])


def label_violations(labels: DataFrame) -> DataFrame:
    """Rows that break a label rule, one row per broken rule; empty means valid."""
    action, passed = F.col("action"), F.col("human_pass_norm")
    judge = lb.text_bool("judge_pass")
    yes_no = ["TRUE", "FALSE"]
    checks = [
        ("invalid action", ~action.isin(fx.AUDIT_ACTIONS)),
        ("override without pass", (action == "override") & ~passed.isin(yes_no)),
        ("exclude with pass", (action == "exclude") & (passed != "NA")),
        (
            "keep differs from judge",
            (action == "keep") & passed.isin(yes_no) & judge.isin(yes_no) & (passed != judge),
        ),
        ("invalid applicable", ~F.col("applicable").isin("TRUE", "FALSE", "NA", "")),
    ]
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))
    return labels.select("review_id", F.explode(broken).alias("violation"))


def effective_pass(action: Column | str, applicable: Column | str, human: Column | str, original: Column | str) -> Column:
    action, applicable = tx.col(action), tx.col(applicable)
    return (
        F.when((action == "exclude") | (applicable == "FALSE"), F.lit(None).cast("boolean"))
        .when(action == "override", lb.bool_of_text(human))
        .otherwise(tx.col(original))
    )


def apply_human_audit(cells: DataFrame, labels: DataFrame, key: Sequence[str] = AUDIT_KEY) -> DataFrame:
    """Cells with their audited score.

    Adds ``judge_pass_before``, ``reviewed``, ``changed`` and the label's action.
    """
    audit = labels.select(
        *key, F.col("review_id"), F.col("action").alias("_a"), F.col("applicable").alias("_ap"),
        F.col("human_pass_norm").alias("_hp"), F.col("reason").alias("_why"),
    )
    rows = cells.join(audit, list(key), "left").withColumn("reviewed", F.col("review_id").isNotNull())
    new = F.when(F.col("reviewed"), effective_pass("_a", "_ap", "_hp", "pass")).otherwise(F.col("pass"))
    changed = F.col("reviewed") & ~new.eqNullSafe(F.col("pass"))
    note = F.concat(
        F.lit("human_adjusted["), F.col("_a"), F.lit("]: "), F.col("_why"), F.lit(" | original: "),
        F.coalesce(F.col("detail"), F.lit("")),
    )
    return (
        rows.withColumns({"_new": new, "changed": changed})
        .withColumns(
            {
                "judge_pass_before": F.col("pass"),
                "detail": F.when(F.col("changed"), note).otherwise(F.col("detail")),
                "human_action": F.col("_a"),
                "pass": F.col("_new"),
            }
        )
        .drop("_new", "_a", "_ap", "_hp", "_why")
    )


def policy_decision(rule_id: str = "rule_id", passed: str = "pass", detail: str = "detail",
                    user_message: str = "user_message", response: str = "response") -> Column:
    """Conservative policy on a judge cell: ``struct<action, applicable, adjusted_pass,
    confidence, issue_type>``."""
    rule, original = tx.col(rule_id), tx.col(passed)
    trigger = rl.has_trigger(rule, user_message, response)

    def decide(action: str, applicable: str, adjusted: Column, confidence: str, issue: Column) -> Column:
        return F.struct(
            F.lit(action).alias("action"), F.lit(applicable).alias("applicable"),
            adjusted.alias("adjusted_pass"), F.lit(confidence).alias("confidence"),
            issue.alias("issue_type"),
        )

    failed = F.coalesce(~original, F.lit(False))
    overstrict = F.lit("false_failure_overstrict")
    return (
        F.when(
            ~trigger["applicable"],
            decide(
                "exclude", "FALSE", F.lit("NA"), "high",
                F.when(original.isNull(), F.lit("already_na")).otherwise(F.lit("false_score_applicability")),
            ),
        )
        .when(
            (rule == "R01") & failed & tx.korean_main(F.coalesce(tx.col(response), F.lit(""))),
            decide("override", "TRUE", F.lit("TRUE"), "high", overstrict),
        )
        .when(
            (rule == "R09") & failed & tx.contains_any(F.coalesce(tx.col(detail), F.lit("")), fx.OVERSTRICT_WORDS),
            decide("override", "TRUE", F.lit("TRUE"), "medium", overstrict),
        )
        .when(original.isNull(), decide("keep", "NA", F.lit("NA"), "high", F.lit("already_na")))
        .otherwise(
            decide(
                "keep", "TRUE", lb.bool_label(original), "high",
                F.when(original, F.lit("true_pass")).otherwise(F.lit("true_failure")),
            )
        )
    )


def policy_candidates(cells: DataFrame) -> DataFrame:
    """One row per judge cell with the policy's decision and ``would_change``."""
    rows = cells.filter(F.col("method").isin(fx.JUDGE_METHODS)).withColumn("_d", policy_decision())
    keep = cells.columns
    return rows.select(
        *keep,
        lb.bool_label("pass").alias("judge_pass"),
        F.col("_d.action").alias("policy_action"),
        F.col("_d.applicable").alias("policy_applicable"),
        F.col("_d.adjusted_pass").alias("adjusted_pass"),
        F.col("_d.confidence").alias("confidence"),
        F.col("_d.issue_type").alias("issue_type"),
        (lb.bool_label("pass") != F.col("_d.adjusted_pass")).alias("would_change"),
    )


def apply_policy(cells: DataFrame) -> DataFrame:
    """Cells with the policy applied; row-local, so metrics follow in one aggregate."""
    decision = F.when(F.col("method").isin(fx.JUDGE_METHODS), policy_decision())
    rows = cells.withColumn("_d", decision)
    changed = F.coalesce(lb.bool_label("pass") != F.col("_d.adjusted_pass"), F.lit(False))
    adjusted = lb.bool_of_text("_d.adjusted_pass")
    note = F.when(adjusted.isNull(), F.lit("not applicable: excluded by audit policy")).otherwise(
        F.concat(
            F.lit("audit adjusted from "), lb.bool_label("pass"), F.lit(" to "), F.col("_d.adjusted_pass")
        )
    )
    return (
        rows.withColumns({"_c": changed, "_n": note, "_p": adjusted})
        .withColumns(
            {
                "pass": F.when(F.col("_c"), F.col("_p")).otherwise(F.col("pass")),
                "detail": F.when(F.col("_c"), F.col("_n")).otherwise(F.col("detail")),
                "policy_changed": F.col("_c"),
            }
        )
        .drop("_d", "_c", "_n", "_p")
    )


def audit_summary(candidates: DataFrame) -> DataFrame:
    """Counts by action, issue type, rule x action and before x after."""
    from holdfast.operators.profiles import counts_by

    return counts_by(
        candidates,
        ["policy_action", "issue_type", ("rule_id", "policy_action"), ("judge_pass", "adjusted_pass")],
    )
