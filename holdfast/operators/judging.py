"""Judge queue, prompts, verdict merge and sidecar replay."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import fixed_values as fx
from holdfast.functions import labels as lb
from holdfast.functions import text as tx
from holdfast.operators.common import RECORD_KEY, positions
from holdfast.operators.records import latest_per_key

SLOT_KEY = [*RECORD_KEY, "turn", "score_index", "rule_id"]

def item_id(turn: Column | str, score_index: Column | str, rule_id: Column | str) -> Column:
    return F.concat(
        F.lit("t"), tx.col(turn).cast("string"), F.lit("_s"), tx.col(score_index).cast("string"),
        F.lit("_"), tx.col(rule_id),
    )


def judge_queue(cells: DataFrame, rules: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Every cell that needs a verdict, with its rule text (by rule id)."""
    judged = F.col("method").isin(fx.JUDGE_METHODS)
    wanted = judged if force else judged & lb.is_unresolved("method", "pass", "detail")
    queue = cells.filter(wanted).withColumns(
        {
            "item_id": item_id("turn", "score_index", "rule_id"),
            "kind": F.when(F.col("method") == "llm_language_judge", F.lit("language")).otherwise(
                F.lit("behavioral")
            ),
        }
    )
    if rules is None:
        return queue
    return queue.join(rules.select("rule_id", F.col("text").alias("rule_text")), "rule_id", "left")


def fill(template: str, **parts: Column | str) -> Column:
    """A prompt column from a template with ``{name}`` marks, each filled once.

    A mark takes the part of its name, or else the column of its name.
    """
    pieces: list[Column] = []
    rest = template
    while True:
        start = rest.find("{")
        end = rest.find("}", start)
        if start < 0 or end < 0:
            break
        name = rest[start + 1 : end]
        pieces += [F.lit(rest[:start]), F.coalesce(tx.col(parts.get(name, name)), F.lit(""))]
        rest = rest[end + 1 :]
    pieces.append(F.lit(rest))
    return F.concat(*pieces)


def judge_prompts(queue: DataFrame, templates: Mapping[str, str]) -> DataFrame:
    """Adds ``prompt``, built from the template of the item's kind; a kind without one is an error."""
    prompt = F.raise_error(F.concat(F.lit("no prompt template for kind "), F.col("kind")))
    for kind, template in templates.items():
        prompt = F.when(F.col("kind") == kind, fill(template)).otherwise(prompt)
    return queue.withColumn("prompt", prompt)


def with_user_message(responses: DataFrame, turns: DataFrame) -> DataFrame:
    """Adds ``user_message``: the user row just before the response (case_id, turn), else null."""
    asked = turns.filter(F.col("role") == "user").select(
        "case_id", (F.col("turn") + 1).alias("turn"), F.col("content").alias("user_message")
    )
    return responses.join(asked, ["case_id", "turn"], "left")


def item_payload() -> Column:
    """One queue item as the JSON object of a batched judge request."""
    return F.to_json(
        F.struct(
            "item_id", "kind", "turn", "rule_id", "rule_text", "user_message",
            F.col("response").alias("assistant_response"),
        )
    )


def batch_requests(queue: DataFrame, batch: int = 32, keys: Sequence[str] = RECORD_KEY) -> DataFrame:
    """One request per record and ``batch`` slots in their order, items as a JSON array.

    Slots are numbered by (turn, score index, rule) within the record, so a record with
    many open slots gives many full requests and none grows without bound.
    """
    rows = positions(queue, keys, "turn", ["score_index", "rule_id"], "_place").withColumn(
        "request_part", F.floor(F.col("_place") / batch))
    return rows.groupBy(*keys, "request_part").agg(
        F.count(F.lit(1)).alias("items"),
        F.concat(
            F.lit("["),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("turn", "score_index", item_payload().alias("p")))),
                    lambda x: x["p"],
                ),
                ",",
            ),
            F.lit("]"),
        ).alias("items_json"),
    )


def merge_verdicts(cells: DataFrame, verdicts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Verdicts into their cells; cells without a verdict stay as they are.

    ``verdicts`` has the key, ``applicable``, ``pass`` and ``reasoning``.
    """
    v = verdicts.select(
        *key, F.col("applicable").alias("_ap"), F.col("pass").alias("_p"), F.col("reasoning").alias("_why")
    )
    rows = cells.join(v, list(key), "left")
    has = F.col("_ap").isNotNull()
    na = has & ~F.col("_ap")
    return rows.withColumns(
        {
            "pass": F.when(na, F.lit(None).cast("boolean")).when(has, F.col("_p")).otherwise(F.col("pass")),
            "detail": F.when(na, F.concat(F.lit("not applicable: "), F.left(F.col("_why"), F.lit(80))))
            .when(has, F.left(F.col("_why"), F.lit(100)))
            .otherwise(F.col("detail")),
            "judged": has,
        }
    ).drop("_ap", "_p", "_why")


def replay_checkpoints(
    cells: DataFrame, checkpoints: DataFrame, order: str, key: Sequence[str] = SLOT_KEY
) -> DataFrame:
    """Latest stored score per slot replaces the cell; entries for unknown or
    non-judge slots are ignored."""
    latest = latest_per_key(checkpoints, key, order).select(
        *key, F.col("pass").alias("_p"), F.col("detail").alias("_d"), F.lit(True).alias("_hit")
    )
    rows = cells.join(latest, list(key), "left")
    use = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("method").isin(fx.JUDGE_METHODS)
    return rows.withColumns(
        {
            "restored": use,
            "pass": F.when(use, F.col("_p")).otherwise(F.col("pass")),
            "detail": F.when(use, F.col("_d")).otherwise(F.col("detail")),
        }
    ).drop("_p", "_d", "_hit")


def to_judge(records: DataFrame) -> DataFrame:
    """Task-accuracy records without a verdict yet."""
    return records.filter((F.col("scoring_type") == "task_accuracy") & F.col("judge_result").isNull())


def task_accuracy(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col("score"), F.lit(0))).alias("accuracy")
    )
