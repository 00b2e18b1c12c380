"""Run-record ingest steps: dedupe, enrich, lookups, remaining work."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import labels as lb
from holdfast.functions import text as tx
from holdfast.operators.common import RECORD_KEY, first_per_key


def dedupe_records(
    records: DataFrame, has_rules: Column, turns: Column, order: str, keys: Sequence[str] = RECORD_KEY
) -> DataFrame:
    """One record per key: rule metadata first, then more turns, then first seen."""
    return first_per_key(
        records, keys, [has_rules.cast("int").desc(), turns.desc(), F.col(order)]
    )


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of every key by ingest order; rows without a key are left out."""
    present = F.lit(True)
    for key in keys:
        present = present & F.coalesce(F.col(key).cast("string") != "", F.lit(False))
    return first_per_key(rows.filter(present), keys, [F.col(order).desc()])


def case_attributes(cases: DataFrame, names: Sequence[str]) -> DataFrame:
    """Case-level columns renamed for a join (``case_<name>``)."""
    return cases.select("case_id", *[F.col(n).alias(f"case_{n}") for n in names])


def enrich_turns(
    turns: DataFrame, cases: DataFrame, case_turns: DataFrame, strict: bool = False,
    overwrite: Sequence[str] = (),
) -> DataFrame:
    """Attach design metadata to turns.

    Default: a turn's own targets and mode win when the field is present (an empty
    list counts as present).  ``strict``: case columns in ``overwrite`` replace the
    record's, a blank or benign mode is replaced by the case's mode for that turn.

    ``cases`` is keyed by case_id, ``case_turns`` by (case_id, turn).
    """
    meta = case_turns.select(
        "case_id", "turn",
        F.col("attack_targets").alias("_meta_targets"),
        lb.attack_mode("attack_mode").alias("_meta_mode"),
    )
    rows = turns.join(meta, ["case_id", "turn"], "left")
    none = F.array().cast("array<string>")
    targets = F.coalesce("attack_targets", "_meta_targets", none)
    if strict:
        rows = rows.join(case_attributes(cases, overwrite), "case_id", "left")
        rows = rows.withColumns({n: F.coalesce(f"case_{n}", n) for n in overwrite}).drop(
            *[f"case_{n}" for n in overwrite]
        )
        own = lb.attack_mode(F.coalesce(F.nullif(F.col("attack_mode"), F.lit("")), F.col("_meta_mode")))
        replace = own.isin("", "benign") & F.coalesce(F.col("_meta_mode") != "", F.lit(False))
        mode = F.when(replace, F.col("_meta_mode")).otherwise(own)
    else:
        mode = F.coalesce("attack_mode", "_meta_mode", F.lit(""))
    return rows.withColumns({"attack_targets": targets, "attack_mode": mode}).drop(
        "_meta_targets", "_meta_mode"
    )


def with_case_defaults(rows: DataFrame, cases: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Carry design columns into result rows; missing ones get their default."""
    joined = rows.join(case_attributes(cases, list(defaults)), "case_id", "left")
    return joined.withColumns(
        {n: F.coalesce(F.col(f"case_{n}"), F.lit(d)) for n, d in defaults.items()}
    ).drop(*[f"case_{n}" for n in defaults])


def rule_metadata(
    records: DataFrame, order: str, last_wins: bool = True, design: str = "design_version"
) -> DataFrame:
    """Type and text per (design, rule) from the records' own rule lists."""
    listed = records.select(F.col(design), F.col(order), F.explode("rules").alias("_r")).select(
        design, order, F.col("_r.rule_id").alias("rule_id"),
        lb.rule_type("_r.type").alias("rule_type"), F.col("_r.text").alias("rule_text"),
    )
    pick = F.max_by if last_wins else F.min_by
    return listed.filter(F.coalesce(F.col("rule_id") != "", F.lit(False))).groupBy(design, "rule_id").agg(
        pick("rule_type", order).alias("rule_type"), pick("rule_text", order).alias("rule_text")
    )


def record_rule_types(records: DataFrame, keys: Sequence[str] = RECORD_KEY) -> DataFrame:
    """(record, rule) -> type, from each record's own rule list."""
    return records.select(*keys, F.explode("rules").alias("_r")).select(
        *keys, F.col("_r.rule_id").alias("rule_id"), lb.rule_type("_r.type").alias("rule_type")
    )


def remaining_runs(plan: DataFrame, done: DataFrame, keys: Sequence[str] = RECORD_KEY) -> DataFrame:
    """Planned runs without a stored result."""
    return plan.join(done.select(*keys), list(keys), "left_anti")


def remaining_requests(plan: DataFrame, responses: DataFrame) -> DataFrame:
    """Planned requests; one is done only if its status is ok and it has text."""
    usable = responses.filter((F.col("status") == "ok") & ~tx.is_blank("response"))
    return plan.join(usable.select("request_id"), "request_id", "left_anti")


def total_tokens(total: Column | str, messages: Column | str) -> Column:
    """Stored token total, or the words of all messages when absent or zero."""
    counted = F.aggregate(
        tx.col(messages), F.lit(0), lambda n, m: n + tx.word_count(F.coalesce(m, F.lit("")))
    )
    return F.coalesce(F.nullif(tx.col(total), F.lit(0)), counted)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Rows of several sources; columns a source lacks become null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def missing_and_extra(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Set difference both ways: ``missing`` from found, ``extra`` in found."""
    missing = expected.select(key).distinct().join(found.select(key), key, "left_anti")
    extra = found.select(key).distinct().join(expected.select(key), key, "left_anti")
    return missing.withColumn("side", F.lit("missing")).unionByName(
        extra.withColumn("side", F.lit("extra"))
    )
