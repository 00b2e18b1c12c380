"""Queries over score cells: turn metrics, conditions, failures, applicability."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions import fixed_values as fx
from holdfast.functions import labels as lb
from holdfast.operators import applicability as ap
from holdfast.operators import cells as ce
from holdfast.operators import conditions as co
from holdfast.operators import failures as fl
from holdfast.operators.common import RECORD_KEY, rounded
from holdfast.plans import testbed as tb
from holdfast.plans.registry import query

STAT_SQL = ", ".join(
    f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std, count({m}) AS {m}_n"
    for m in fx.METRICS
)
METRICS_R = ", ".join(f"round({m}, 6) AS {m}" for m in fx.METRICS)


def grid_sql(**levels) -> str:
    parts = []
    for name, values in levels.items():
        listed = ", ".join(f"({v!r})" for v in values)
        parts.append(f"(VALUES {listed}) AS v_{name}({name})")
    return " CROSS JOIN ".join(parts)


@query("turn_metric_bundle", f"WITH {tb.TURNS_SQL} SELECT case_id, turn, {METRICS_R} FROM turns")
def turn_metric_bundle(spark, sf):
    return rounded(ce.turn_metrics(tb.score_cells(spark, sf), ["case_id", "turn"]))


@query("final_turn_metrics", f"WITH {tb.FINAL_SQL} SELECT case_id, turn, {METRICS_R} FROM finals")
def final_turn_metrics(spark, sf):
    return rounded(tb.finals(spark, sf).select("case_id", "turn", *fx.METRICS))


CONDITION_KEYS = "temperature, rule_count, turn_count, attack_intensity"


@query(
    "condition_table",
    f"""WITH {tb.FINAL_SQL} SELECT {CONDITION_KEYS}, count(*) AS n, {STAT_SQL},
    round((avg(per_rule_pass_rate) - avg(perfect_success)) * 100, 6) AS gap_pp
    FROM finals GROUP BY {CONDITION_KEYS}""",
)
def condition_table(spark, sf):
    return rounded(co.condition_table(tb.finals(spark, sf)))


GRID_N0 = ", ".join(f"coalesce({m}_n, 0) AS {m}_n, {m}_mean, {m}_std" for m in fx.METRICS)


@query(
    "condition_grid",
    f"""WITH {tb.FINAL_SQL}, t AS (SELECT rule_count, turn_count, attack_intensity, {STAT_SQL}
      FROM finals GROUP BY 1, 2, 3)
    SELECT rule_count, turn_count, attack_intensity, {GRID_N0}
    FROM {grid_sql(rule_count=fx.RULE_COUNTS, turn_count=fx.TURN_COUNTS, attack_intensity=fx.ATTACK_INTENSITIES)}
    LEFT JOIN t USING (rule_count, turn_count, attack_intensity)""",
)
def condition_grid(spark, sf):
    return rounded(co.condition_grid(tb.finals(spark, sf)))


@query(
    "target_rule_grid",
    f"""WITH {tb.FINAL_SQL}, t AS (SELECT target_rule_id, rule_count, turn_count, attack_intensity, {STAT_SQL}
      FROM finals GROUP BY 1, 2, 3, 4), ids AS (SELECT DISTINCT target_rule_id FROM finals)
    SELECT target_rule_id, rule_count, turn_count, attack_intensity, {GRID_N0}
    FROM ids CROSS JOIN
    {grid_sql(rule_count=fx.RULE_COUNTS, turn_count=tb.TURN_LEVELS, attack_intensity=fx.ATTACK_INTENSITIES)}
    LEFT JOIN t USING (target_rule_id, rule_count, turn_count, attack_intensity)""",
)
def target_rule_grid(spark, sf):
    return rounded(co.target_rule_grid(tb.finals(spark, sf), turn_counts=tb.TURN_LEVELS))


@query(
    "attack_order_table",
    f"""WITH {tb.FINAL_SQL} SELECT rule_count, turn_count, attack_order_variant, {STAT_SQL} FROM finals
    WHERE attack_intensity = 'adversarial' GROUP BY 1, 2, 3""",
)
def attack_order_table(spark, sf):
    return rounded(co.attack_order_table(tb.finals(spark, sf)))


FAIL_COUNTS = "count(*) FILTER (NOT pass) AS failed, count(pass) AS total"
FAIL_RATE = "round(count(*) FILTER (NOT pass) / count(pass), 6) AS failure_rate"


@query(
    "rule_failure_table",
    f"""WITH {tb.FINAL_CELLS_SQL} SELECT rule_id, rule_count, turn_count, attack_intensity, {FAIL_COUNTS},
    {FAIL_RATE} FROM final_cells WHERE pass IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def rule_failure_table(spark, sf):
    """In the published order: rule ids by their number."""
    table = rounded(co.rule_failure_table(tb.final_counts(spark, sf)))
    return co.published_order(table, ["rule_id", "rule_count", "turn_count", "attack_intensity"])


@query(
    "final_cell_stats",
    f"""WITH {tb.FINAL_SQL} SELECT attack_intensity, rule_count, turn_count,
    round(avg(per_rule_pass_rate), 6) AS compliance_rate_mean,
    round(stddev_pop(per_rule_pass_rate), 6) AS compliance_rate_std, count(*) AS compliance_rate_n
    FROM finals GROUP BY 1, 2, 3""",
)
def final_cell_stats(spark, sf):
    return rounded(co.final_cell_stats(tb.finals(spark, sf)))


@query(
    "rule_type_pass_rates",
    f"""WITH {tb.CELLS_SQL} SELECT attack_intensity, turn_count, rule_type,
    round(avg(pass::INT), 6) AS mean, count(*) AS n FROM cells
    WHERE has_rules AND pass IS NOT NULL GROUP BY 1, 2, 3""",
)
def rule_type_pass_rates(spark, sf):
    return rounded(co.rule_type_pass_rates(tb.score_cells(spark, sf)))


@query(
    "threshold_detection",
    f"""WITH {tb.TURNS_SQL}, f AS (SELECT case_id, rule_count, attack_intensity,
      min(turn) FILTER (per_rule_pass_rate < 0.8) AS o, min(turn) FILTER (per_rule_pass_rate < 0.5) AS c
      FROM turns GROUP BY 1, 2, 3)
    SELECT rule_count, attack_intensity, round(avg(o), 6) AS onset_mean_turn, count(o) AS onset_n,
      round(avg(c), 6) AS critical_mean_turn, count(c) AS critical_n FROM f GROUP BY 1, 2""",
)
def threshold_detection(spark, sf):
    per_turn = tb.with_record_columns(ce.turn_metrics(tb.score_cells(spark, sf), ["case_id", "turn"]))
    return rounded(co.threshold_detection(per_turn, ["case_id"]))


@query(
    "overall_attack_gap",
    f"""WITH {tb.FINAL_SQL}, s AS (SELECT
      avg(per_rule_pass_rate) FILTER (attack_intensity = 'benign') AS b,
      avg(per_rule_pass_rate) FILTER (attack_intensity = 'adversarial') AS a FROM finals)
    SELECT round(b, 6) AS benign_mean, round(a, 6) AS adversarial_mean, round((b - a) * 100, 6) AS gap_pp FROM s""",
)
def overall_attack_gap(spark, sf):
    return rounded(co.overall_gap(tb.finals(spark, sf)))


@query(
    "gap_matrix",
    f"""WITH {tb.FINAL_SQL}, c AS (SELECT rule_count, turn_count,
      (avg(perfect_success) FILTER (attack_intensity = 'benign')
       - avg(perfect_success) FILTER (attack_intensity = 'adversarial')) * 100 AS g
      FROM finals GROUP BY 1, 2)
    SELECT rule_count, round(max(g) FILTER (turn_count = 1), 6) AS t01,
      round(max(g) FILTER (turn_count = 3), 6) AS t03, round(max(g) FILTER (turn_count = 5), 6) AS t05,
      round(max(g) FILTER (turn_count = 7), 6) AS t07 FROM c GROUP BY 1""",
)
def gap_matrix(spark, sf):
    return rounded(co.gap_matrix(tb.finals(spark, sf), tb.TURN_LEVELS))


@query(
    "headline_summary",
    f"""WITH {tb.FINAL_SQL}, c AS (SELECT rule_count, turn_count,
      avg(perfect_success) FILTER (attack_intensity = 'benign') AS b,
      avg(perfect_success) FILTER (attack_intensity = 'adversarial') AS a,
      avg(targeted_rule_success) FILTER (attack_intensity = 'adversarial') AS t,
      avg(non_target_failure) FILTER (attack_intensity = 'adversarial') AS x
      FROM finals GROUP BY 1, 2)
    SELECT round(avg(b), 6) AS mean_benign_perfect_success, round(avg(a), 6) AS mean_adversarial_perfect_success,
      round(avg(t), 6) AS mean_adversarial_targeted_rule_success,
      round(avg(x), 6) AS mean_adversarial_non_target_failure,
      round(avg(b - a), 6) AS mean_benign_minus_adversarial_gap FROM c""",
)
def headline_summary(spark, sf):
    return rounded(co.headline_summary(tb.finals(spark, sf)))


@query(
    "order_variant_means",
    f"""WITH {tb.FINAL_SQL}, c AS (SELECT rule_count, turn_count, attack_order_variant,
      avg(per_rule_pass_rate) AS m FROM finals
      WHERE attack_order_variant IN ('implicit_then_adversarial', 'adversarial_then_implicit') GROUP BY 1, 2, 3)
    SELECT attack_order_variant, round(avg(m), 6) AS per_rule_pass_rate_mean, count(*) AS cells FROM c GROUP BY 1""",
)
def order_variant_means(spark, sf):
    return rounded(co.order_variant_means(tb.finals(spark, sf)))


@query(
    "longest_adversarial_appendix",
    f"""WITH {tb.FINAL_SQL} SELECT target_rule_id, rule_count, count(perfect_success) AS perfect_success_n,
      round(avg(perfect_success), 6) AS perfect_success_mean,
      round(avg(targeted_rule_success), 6) AS targeted_rule_success_mean,
      round(avg(non_target_failure), 6) AS non_target_failure_mean
    FROM finals WHERE attack_intensity = 'adversarial' AND turn_count = 7 GROUP BY 1, 2""",
)
def longest_adversarial_appendix(spark, sf):
    keys = ["target_rule_id", "rule_count", "turn_count", "attack_intensity"]
    return rounded(
        co.longest_adversarial_appendix(co.condition_table(tb.finals(spark, sf), keys), 7)
    )


@query(
    "single_condition_reading",
    f"""WITH {tb.FINAL_SQL} SELECT rule_count, turn_count, attack_intensity, count(*) AS n, {STAT_SQL},
      round((avg(per_rule_pass_rate) - avg(perfect_success)) * 100, 6) AS gap_pp
    FROM finals WHERE rule_count = 5 AND turn_count = 3 AND attack_intensity = 'adversarial' GROUP BY 1, 2, 3""",
)
def single_condition_reading(spark, sf):
    table = co.condition_table(tb.finals(spark, sf), ["rule_count", "turn_count", "attack_intensity"])
    return rounded(co.metric_of_cell(table, 5, 3, "adversarial"))


# --- failures -----------------------------------------------------------------


@query(
    "category_failure_grid",
    f"""WITH {tb.FINAL_CELLS_SQL}, t AS (SELECT attack_intensity, rule_type, {FAIL_COUNTS}
      FROM final_cells WHERE pass IS NOT NULL GROUP BY 1, 2)
    SELECT attack_intensity, rule_type, coalesce(failed, 0) AS failed, coalesce(total, 0) AS total,
      round(failed / total, 6) AS failure_rate
    FROM {grid_sql(attack_intensity=fx.ATTACK_INTENSITIES, rule_type=fx.RULE_TYPES)}
    LEFT JOIN t USING (attack_intensity, rule_type)""",
)
def category_failure_grid(spark, sf):
    return rounded(fl.category_failure_grid(tb.final_counts(spark, sf)))


@query(
    "failed_rule_counts",
    f"""WITH {tb.FINAL_CELLS_SQL} SELECT rule_id, rule_type, count(DISTINCT case_id) AS records
    FROM final_cells WHERE NOT pass GROUP BY 1, 2""",
)
def failed_rule_counts(spark, sf):
    return fl.failed_rule_counts(tb.final_counts(spark, sf))


@query(
    "target_failed_rule_matrix",
    f"""WITH {tb.FINAL_CELLS_SQL}, f AS (SELECT DISTINCT case_id, attack_targets, rule_id FROM final_cells
      WHERE attack_intensity = 'adversarial' AND NOT pass),
    t AS (SELECT case_id, unnest(attack_targets) AS target FROM (SELECT DISTINCT case_id, attack_targets FROM f)),
    d AS (SELECT target, count(*) AS n FROM t GROUP BY 1),
    p AS (SELECT target, rule_id, count(*) AS c FROM t JOIN f USING (case_id) GROUP BY 1, 2),
    ids(rule_id, rule_type) AS (VALUES ('R01','language'), ('R02','format'), ('R03','format'),
      ('R04','behavior'), ('R05','behavior'), ('R06','persona'), ('R07','persona'))
    SELECT d.target AS attack_target_rule_id, tt.rule_type AS attack_target_type, d.n AS records_with_target,
      i.rule_id AS failed_rule_id, i.rule_type AS failed_rule_type, coalesce(p.c, 0) AS failed_count,
      round(coalesce(p.c, 0) / d.n, 6) AS failed_rate
    FROM d JOIN ids tt ON tt.rule_id = d.target CROSS JOIN ids i
    LEFT JOIN p ON p.target = d.target AND p.rule_id = i.rule_id""",
)
def target_failed_rule_matrix(spark, sf):
    counts = tb.final_counts(spark, sf, "attack_targets")
    return rounded(fl.target_failed_rule_matrix(counts, ["case_id"], list(tb.RULE_TYPES.items())))


def _turnwise_sql(key: str, keys: str) -> str:
    return f"""WITH {tb.HORIZON_SQL} SELECT {keys}, turn, {key}, {FAIL_COUNTS}, {FAIL_RATE}
    FROM horizon WHERE pass IS NOT NULL GROUP BY ALL"""


FULL = "temperature, attack_intensity, rule_count"


def _horizon_counts(spark, sf, key):
    cells = ce.longest_horizon(tb.score_cells(spark, sf)).filter(F.col("pass").isNotNull())
    return ce.cell_counts(cells, ["temperature", "attack_intensity", "rule_count", "turn", key])


@query("turnwise_category_failure", _turnwise_sql("rule_type", FULL))
def turnwise_category_failure(spark, sf):
    keys = ["temperature", "attack_intensity", "rule_count", "turn", "rule_type"]
    return rounded(fl.failure_rates(_horizon_counts(spark, sf, "rule_type"), keys))


@query("turnwise_rule_failure", _turnwise_sql("rule_id", FULL))
def turnwise_rule_failure(spark, sf):
    keys = ["temperature", "attack_intensity", "rule_count", "turn", "rule_id"]
    return rounded(fl.failure_rates(_horizon_counts(spark, sf, "rule_id"), keys))


@query("turnwise_category_rollup", _turnwise_sql("rule_type", "temperature, attack_intensity"))
def turnwise_category_rollup(spark, sf):
    keys = ["temperature", "attack_intensity", "turn", "rule_type"]
    return rounded(fl.failure_rates(_horizon_counts(spark, sf, "rule_type"), keys))


def _first_sql(key: str) -> str:
    return f"""WITH {tb.HORIZON_SQL} SELECT temperature, attack_intensity, rule_count, {key},
      count(*) AS trajectories, count(first_failure_turn) AS failed_trajectories,
      round(count(first_failure_turn) / count(*), 6) AS failure_rate,
      round(avg(first_failure_turn), 6) AS mean_first_failure_turn,
      round(quantile_cont(first_failure_turn, 0.5), 6) AS median_first_failure_turn,
      round(quantile_cont(first_failure_turn, 0.25), 6) AS p25_first_failure_turn,
      round(quantile_cont(first_failure_turn, 0.75), 6) AS p75_first_failure_turn,
      min(first_failure_turn) AS min_first_failure_turn, max(first_failure_turn) AS max_first_failure_turn
    FROM firsts GROUP BY 1, 2, 3, 4"""


@query("first_failure_by_category", _first_sql("rule_type"))
def first_failure_by_category(spark, sf):
    keys = ["temperature", "attack_intensity", "rule_count", "rule_type"]
    return rounded(fl.first_failure_summary(tb.first_failures(spark, sf), keys))


@query("first_failure_by_rule", _first_sql("rule_id"))
def first_failure_by_rule(spark, sf):
    keys = ["temperature", "attack_intensity", "rule_count", "rule_id"]
    return rounded(fl.first_failure_summary(tb.first_failures(spark, sf), keys))


def _first_grid_sql(key: str, members: list[str]) -> str:
    return f"""WITH {tb.HORIZON_SQL}, t AS (SELECT attack_intensity, {key}, count(*) AS trajectories,
      count(first_failure_turn) AS failed, avg(first_failure_turn) AS m FROM firsts GROUP BY 1, 2)
    SELECT attack_intensity, {key}, coalesce(trajectories, 0) AS trajectories, coalesce(failed, 0) AS failed,
      round(coalesce(failed * 100.0 / trajectories, 0.0), 6) AS failure_rate_pct, round(m, 6) AS mean_first_turn
    FROM {grid_sql(attack_intensity=fx.ATTACK_INTENSITIES, **{key: members})} LEFT JOIN t USING (attack_intensity, {key})"""


@query("first_failure_grid_rule", _first_grid_sql("rule_id", [*tb.RULE_IDS, "R09"]))
def first_failure_grid_rule(spark, sf):
    return rounded(fl.first_failure_grid(tb.first_failures(spark, sf), "rule_id", [*tb.RULE_IDS, "R09"]))


@query("first_failure_grid_category", _first_grid_sql("rule_type", fx.RULE_TYPES))
def first_failure_grid_category(spark, sf):
    return rounded(fl.first_failure_grid(tb.first_failures(spark, sf), "rule_type", fx.RULE_TYPES))


# --- applicability ------------------------------------------------------------

NA_SQL = """count(*) FILTER (pass) AS passed, count(*) FILTER (NOT pass) AS failed,
  count(*) FILTER (pass IS NULL) AS na, count(pass) AS scorable, count(*) AS active,
  round(count(pass) / count(*), 6) AS applicability_rate,
  round(count(*) FILTER (NOT pass) / nullif(count(pass), 0), 6) AS conditional_failure_rate,
  round(count(*) FILTER (NOT pass) / count(*), 6) AS opportunity_failure_rate"""


@query(
    "applicability_final",
    f"""WITH {tb.FINAL_CELLS_SQL} SELECT temperature, attack_intensity, rule_count, rule_type, {NA_SQL}
    FROM final_cells GROUP BY 1, 2, 3, 4""",
)
def applicability_final(spark, sf):
    keys = ["temperature", "attack_intensity", "rule_count", "rule_type"]
    return rounded(ap.applicability_table(tb.final_counts(spark, sf), keys))


@query(
    "applicability_by_turn",
    f"""WITH {tb.CELLS_SQL} SELECT temperature, attack_intensity, rule_count, turn, rule_type, {NA_SQL}
    FROM cells GROUP BY 1, 2, 3, 4, 5""",
)
def applicability_by_turn(spark, sf):
    keys = ["temperature", "attack_intensity", "rule_count", "turn", "rule_type"]
    return rounded(ap.applicability_table(ce.cell_counts(tb.score_cells(spark, sf), keys), keys))


@query(
    "applicability_final_rollup",
    f"""WITH {tb.FINAL_CELLS_SQL} SELECT temperature, attack_intensity, rule_count, rule_type, {NA_SQL},
      CASE WHEN grouping(rule_count) = 1 THEN 'overall' ELSE 'detail' END AS level
    FROM final_cells GROUP BY GROUPING SETS ((temperature, attack_intensity, rule_count, rule_type),
      (temperature, attack_intensity, rule_type))""",
)
def applicability_final_rollup(spark, sf):
    keys = ["temperature", "attack_intensity", "rule_count", "rule_type"]
    return rounded(ap.applicability_table(tb.final_counts(spark, sf), keys, "rule_count"))


@query(
    "applicability_turn_rollup",
    f"""WITH {tb.CELLS_SQL} SELECT temperature, attack_intensity, rule_count, turn, rule_type, {NA_SQL},
      CASE WHEN grouping(rule_count) = 1 THEN 'overall' ELSE 'detail' END AS level
    FROM cells GROUP BY GROUPING SETS ((temperature, attack_intensity, rule_count, turn, rule_type),
      (temperature, attack_intensity, turn, rule_type))""",
)
def applicability_turn_rollup(spark, sf):
    keys = ["temperature", "attack_intensity", "rule_count", "turn", "rule_type"]
    return rounded(
        ap.applicability_table(ce.cell_counts(tb.score_cells(spark, sf), keys), keys, "rule_count")
    )


# --- first failure and status per record -----------------------------------------


@query(
    "first_failed_turn_by_record",
    f"""WITH {tb.CELLS_SQL} SELECT case_id, min(turn) FILTER (NOT pass) AS first_failure_turn
    FROM cells GROUP BY 1""",
)
def first_failed_turn_by_record(spark, sf):
    return ce.first_failed_turn(tb.score_cells(spark, sf), ["case_id"])


@query(
    "first_turn_below_80",
    f"""WITH {tb.TURNS_SQL} SELECT case_id, min(turn) FILTER (per_rule_pass_rate < 0.8) AS first_turn_below
    FROM turns GROUP BY 1""",
)
def first_turn_below_80(spark, sf):
    per_turn = ce.turn_metrics(tb.score_cells(spark, sf), ["case_id", "turn"])
    return ce.first_turn_below(per_turn, ["case_id"], 0.8)


UNRESOLVED_SQL = """method IN ('llm_judge', 'llm_language_judge') AND pass IS NULL
  AND NOT starts_with(lower(detail), 'not applicable')"""


@query(
    "record_judge_status",
    f"""WITH {tb.CELLS_SQL}, u AS (SELECT case_id, rep, model, temperature,
      count(*) FILTER ({UNRESOLVED_SQL}) AS unresolved FROM cells GROUP BY 1, 2, 3, 4)
    SELECT *, CASE WHEN unresolved = 0 THEN 'complete' ELSE 'incomplete' END AS judge_status FROM u""",
)
def record_judge_status(spark, sf):
    return ce.unresolved_counts(tb.score_cells(spark, sf), RECORD_KEY)


@query(
    "natural_rule_order",
    f"""WITH {tb.CELLS_SQL} SELECT rule_id, count(*) AS cells,
      coalesce(TRY_CAST(nullif(regexp_replace(rule_id, '[^0-9]', '', 'g'), '') AS INTEGER), 999) AS rule_number
    FROM (SELECT CASE WHEN rn = 7 THEN 'R10' WHEN rn = 6 THEN 'custom' ELSE rule_id END AS rule_id FROM cells)
    GROUP BY 1""",
)
def natural_rule_order(spark, sf):
    renamed = (
        F.when(F.col("rule_id") == "R07", F.lit("R10"))
        .when(F.col("rule_id") == "R06", F.lit("custom"))
        .otherwise(F.col("rule_id"))
    )
    counts = tb.score_cells(spark, sf).groupBy(renamed.alias("rule_id")).agg(F.count(F.lit(1)).alias("cells"))
    return counts.withColumn("rule_number", lb.natural_rule_number("rule_id")).orderBy(
        *lb.natural_rule_order("rule_id")
    )
