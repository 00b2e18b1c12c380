"""Request-level human labels and the native-safety baseline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import fixed_values as fx
from holdfast.functions import labels as lb
from holdfast.functions import rules as rl
from holdfast.functions import text as tx
from holdfast.operators.records import latest_per_key

LABEL_COLUMNS = {
    "targeted_rule_success": "human_target_rule_pass",
    "perfect_success": "human_perfect_success",
    "non_target_failure": "human_non_target_failure",
}
LABEL_GROUPINGS = [
    ("target_rule_category", "attack_type"),
    ("model_name", "target_rule_category", "attack_type"),
    ("model_name", "attack_type"),
    ("target_rule_id", "target_rule_category", "attack_type"),
]


def repair_labels(rows: DataFrame) -> DataFrame:
    """Normalise the three labels, fill and derive what follows from the others.

    ``unresolved`` marks rows whose labels are still not TRUE / FALSE; their strict
    label is left as typed.
    """
    target, strict, other = LABEL_COLUMNS.values()
    rows = rows.withColumns({c: lb.label_text(F.coalesce(F.col(c), F.lit(""))) for c in LABEL_COLUMNS.values()})
    rows = rows.withColumn(
        target, F.when((F.col(target) == "") & (F.col(strict) == "TRUE"), F.lit("TRUE")).otherwise(F.col(target))
    )
    bad = F.lit(False)
    for c in LABEL_COLUMNS.values():
        bad = bad | ~F.col(c).isin("TRUE", "FALSE")
    derived = F.when((F.col(target) == "TRUE") & (F.col(other) == "FALSE"), F.lit("TRUE")).otherwise(F.lit("FALSE"))
    rows = rows.withColumns({"unresolved": bad, "_derived": derived})
    fix = ~F.col("unresolved") & (F.col(strict) != F.col("_derived"))
    note = F.nullif(tx.strip(F.coalesce(F.col("human_notes"), F.lit(""))), F.lit(""))
    return rows.withColumn("repaired", fix).withColumns(
        {
            strict: F.when(F.col("repaired"), F.col("_derived")).otherwise(F.col(strict)),
            "human_notes": F.when(
                F.col("repaired"), F.concat_ws("; ", note, F.lit(fx.CONSISTENCY_NOTE))
            ).otherwise(F.coalesce(F.col("human_notes"), F.lit(""))),
        }
    ).drop("_derived")


def with_label_metrics(rows: DataFrame) -> DataFrame:
    """TRUE / FALSE labels as 1.0 / 0.0 metric columns, anything else null."""
    return rows.withColumns(
        {m: lb.bool_of_text(c).cast("double") for m, c in LABEL_COLUMNS.items()}
    )


def label_rates(rows: DataFrame, groupings: Sequence[Sequence[str]] = LABEL_GROUPINGS) -> DataFrame:
    """Rates x 100 and n for all groupings in one pass; null keys are kept.

    ``grouping`` names the key columns of a row.
    """
    names = list(dict.fromkeys(c for g in groupings for c in g))
    grouped = rows.groupingSets([list(g) for g in groupings], *names).agg(
        *[(F.avg(m) * 100).alias(m) for m in LABEL_COLUMNS],
        F.count(F.lit(1)).alias("n"),
        F.grouping_id().alias("_set"),
    )
    label = F.lit(None).cast("string")
    for g in groupings:
        bits = sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in g)
        label = F.when(F.col("_set") == bits, F.lit("+".join(g))).otherwise(label)
    return grouped.withColumn("grouping", label).drop("_set")


def rate_matrix(
    rows: DataFrame, row_key: str, column: Column, columns: Mapping[str, str], value: str
) -> DataFrame:
    """Mean x 100 as a matrix with fixed columns (``output name -> member``)."""
    keyed = rows.withColumn("_c", column)
    return keyed.groupBy(row_key).agg(
        *[
            (F.avg(F.when(F.col("_c") == member, F.col(value).cast("double"))) * 100).alias(name)
            for name, member in columns.items()
        ]
    )


def metrics_long(table: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return table.unpivot(list(ids), list(metrics), "metric", "rate")


def audit_safety(responses: DataFrame) -> DataFrame:
    """Responses with the native-safety audit columns."""
    return responses.withColumn("_a", rl.safety_audit("target_rule_id", "response")).select(
        *responses.columns, "_a.*"
    )


def safety_rates(
    audited: DataFrame,
    groupings: Sequence[Sequence[str]] = (
        ("model_name",), ("target_rule_id", "attack_type"),
        ("model_name", "target_rule_id", "attack_type"), ("model_name", "attack_type"),
    ),
) -> DataFrame:
    names = list(dict.fromkeys(c for g in groupings for c in g))
    grouped = audited.groupingSets([list(g) for g in groupings], *names).agg(
        (F.avg(F.col("native_safety_pass").cast("double")) * 100).alias("native_safety_pass_rate"),
        F.count(F.lit(1)).alias("n"),
        F.grouping_id().alias("_set"),
    )
    label = F.lit(None).cast("string")
    for g in groupings:
        bits = sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in g)
        label = F.when(F.col("_set") == bits, F.lit("+".join(g))).otherwise(label)
    return grouped.withColumn("grouping", label).drop("_set")


def usage_diagnostics(responses: DataFrame) -> DataFrame:
    """Mean completion and reasoning tokens and total cost per model."""
    return responses.groupBy("model_name").agg(
        F.avg("usage.completion_tokens").alias("avg_completion_tokens"),
        F.avg(F.coalesce(F.col("usage.reasoning_tokens"), F.lit(0))).alias("avg_reasoning_tokens"),
        F.sum(F.coalesce(F.col("usage.cost"), F.lit(0.0))).alias("total_cost"),
    )


def usage_value(*names: str) -> Column:
    """First present usage field, e.g. prompt_tokens or input_tokens."""
    return F.coalesce(*[F.col(f"usage.{n}") for n in names])


def label_export(records: DataFrame, order: str = "ingest_ord") -> DataFrame:
    """The sheet that people label: the latest record of every request, all cells as text.

    Absent columns and values are empty cells, and the label cells are empty.  Records
    without a request id are left out.
    """
    known = records.filter(F.coalesce(F.col("request_id"), F.lit("")) != "")
    rows = latest_per_key(known, ["request_id"], order)

    def cell(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in rows.columns else F.lit("")

    usage = next((f.dataType.names for f in rows.schema if f.name == "usage"), [])

    def used(names: list[str]) -> Column:
        there = [n for n in names if n in usage]
        return F.coalesce(usage_value(*there).cast("string"), F.lit("")) if there else F.lit("")

    return rows.select(
        *[cell(source).alias(name) for name, source in fx.LABEL_EXPORT.items()],
        *[used(names).alias(name) for name, names in fx.LABEL_USAGE.items()],
        *[F.lit("").alias(name) for name in fx.LABEL_EMPTY],
        *[cell(source).alias(name) for name, source in fx.LABEL_HASHES.items()],
    )
