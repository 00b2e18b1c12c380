"""Queries on attack turns, matched pairs, collapse events and run profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions import fixed_values as fx
from holdfast.functions import labels as lb
from holdfast.operators import attacks as at
from holdfast.operators import cells as ce
from holdfast.operators import profiles as pf
from holdfast.operators.common import rounded
from holdfast.plans import testbed as tb
from holdfast.plans.registry import query
from holdfast.plans.score_queries import STAT_SQL

ATTACK_SQL = f"""{tb.TURNS_SQL},
attack AS (
  SELECT *, CASE WHEN turn_count = 1 THEN 'single_attack' WHEN turn = turn_count - 1 THEN 'first_attack'
    WHEN turn = turn_count THEN 'second_attack' ELSE 'attack_turn' END AS attack_position
  FROM turns WHERE attack_mode IN ('implicit_attack', 'adversarial_attack')
    AND condition IN ('injection_context', 'escalation_attack')),
tags(comparison_subset) AS (VALUES ('all_attack_turns'), ('paired_T5_T10_T15'), ('first_attack_only'),
  ('second_attack_only')),
tagged AS (
  SELECT t.comparison_subset, a.* FROM attack a, tags t
  WHERE t.comparison_subset = 'all_attack_turns'
    OR (t.comparison_subset = 'paired_T5_T10_T15' AND turn_count > 1)
    OR (t.comparison_subset = 'first_attack_only' AND attack_position = 'first_attack')
    OR (t.comparison_subset = 'second_attack_only' AND attack_position = 'second_attack'))
"""
TWO_SETS = "comparison_subset IN ('all_attack_turns', 'paired_T5_T10_T15')"

COMPACT_KEYS = ["case_id", "turn", "attack_mode"]


def turns_of(spark, sf):
    """Turn metrics keyed by record, turn and (normalised) mode, attributes re-attached."""
    cells = tb.score_cells(spark, sf).withColumn("attack_mode", lb.attack_mode("attack_mode"))
    return tb.with_record_columns(ce.turn_metrics(cells, COMPACT_KEYS))


def attack_rows(spark, sf):
    return at.attack_turns(turns_of(spark, sf))


@query(
    "attack_turn_rows",
    f"""WITH {ATTACK_SQL} SELECT case_id, turn, turn_count, attack_mode, attack_position, attack_order_variant,
      target_rule_id, round(per_rule_pass_rate, 6) AS per_rule_pass_rate, perfect_success,
      targeted_rule_success, non_target_failure FROM attack""",
)
def attack_turn_rows(spark, sf):
    return rounded(
        attack_rows(spark, sf).select(
            "case_id", "turn", "turn_count", "attack_mode", "attack_position", "attack_order_variant",
            "target_rule_id", *fx.METRICS,
        )
    )


@query(
    "attack_score_cells",
    f"""WITH {tb.CELLS_SQL} SELECT case_id, turn, attack_mode, score_index, rule_id, rule_type, NOT pass AS failed,
      list_contains(attack_targets, rule_id) AS is_target_rule_score FROM cells
    WHERE condition = 'injection_context' AND attack_mode <> 'benign' AND pass IS NOT NULL""",
)
def attack_score_cells(spark, sf):
    rows = at.attack_turns(tb.score_cells(spark, sf)).filter(F.col("pass").isNotNull())
    return rows.select(
        "case_id", "turn", "attack_mode", "score_index", "rule_id", "rule_type",
        (~F.col("pass")).alias("failed"), F.col("is_target").alias("is_target_rule_score"),
    )


@query(
    "attack_mode_metrics",
    f"WITH {ATTACK_SQL} SELECT comparison_subset, attack_mode, {STAT_SQL} FROM tagged WHERE {TWO_SETS} GROUP BY 1, 2",
)
def attack_mode_metrics(spark, sf):
    rows = at.with_subsets(attack_rows(spark, sf))
    return rounded(at.attack_metric_table(rows, ["comparison_subset", "attack_mode"]))


@query(
    "attack_mode_metrics_by_turns",
    f"WITH {ATTACK_SQL} SELECT turn_count, attack_mode, {STAT_SQL} FROM attack GROUP BY 1, 2",
)
def attack_mode_metrics_by_turns(spark, sf):
    return rounded(at.attack_metric_table(attack_rows(spark, sf), ["turn_count", "attack_mode"]))


@query(
    "attack_metrics_by_target_category",
    f"""WITH {ATTACK_SQL} SELECT comparison_subset, attack_mode, target_rule_category, {STAT_SQL}
    FROM tagged WHERE {TWO_SETS} GROUP BY 1, 2, 3""",
)
def attack_metrics_by_target_category(spark, sf):
    rows = at.with_subsets(attack_rows(spark, sf))
    keys = ["comparison_subset", "attack_mode", "target_rule_category"]
    return rounded(at.attack_metric_table(rows, keys))


@query(
    "attack_category_failures",
    f"""WITH {tb.CELLS_SQL}, a AS (SELECT * FROM cells WHERE attack_mode <> 'benign' AND pass IS NOT NULL
      AND condition = 'injection_context'),
    s AS (SELECT 'all_attack_turns' AS comparison_subset, * FROM a UNION ALL
      SELECT 'paired_T5_T10_T15', * FROM a WHERE turn_count > 1)
    SELECT comparison_subset, attack_mode, rule_type, count(*) FILTER (NOT pass) AS failed_scores,
      count(*) AS scorable_scores, round(count(*) FILTER (NOT pass) / count(*), 6) AS failure_rate
    FROM s GROUP BY 1, 2, 3""",
)
def attack_category_failures(spark, sf):
    cells = at.attack_turns(tb.score_cells(spark, sf))
    counts = ce.cell_counts(cells, ["turn_count", "attack_mode", "rule_type"])
    return rounded(at.attack_category_failures(counts))


CHANGE_NAMES = [n for m in fx.METRICS for n in (m, f"delta_from_previous_{m}", f"drop_from_previous_{m}")]
CHANGE_SQL = f"""{ATTACK_SQL},
changed AS (
  SELECT a.*, {", ".join(f"p.{m} AS previous_{m}, a.{m} - p.{m} AS delta_from_previous_{m}, p.{m} - a.{m} AS drop_from_previous_{m}" for m in fx.METRICS)}
  FROM tagged a LEFT JOIN turns p ON p.case_id = a.case_id AND p.turn = a.turn - 1)
"""
CHANGE_STATS = ", ".join(
    f"round(avg({n}), 6) AS {n}_mean, round(stddev_pop({n}), 6) AS {n}_std, count({n}) AS {n}_n"
    for n in CHANGE_NAMES
)


def _changes(spark, sf):
    every = turns_of(spark, sf)
    return at.with_previous_turn(at.attack_turns(every), every, ["case_id"])


@query(
    "attack_turn_changes",
    f"""WITH {CHANGE_SQL} SELECT case_id, turn, {", ".join(f"round({p}{m}, 6) AS {p}{m}" for m in fx.METRICS for p in ("previous_", "delta_from_previous_", "drop_from_previous_"))}
    FROM changed WHERE comparison_subset = 'all_attack_turns'""",
)
def attack_turn_changes(spark, sf):
    names = [f"{p}{m}" for m in fx.METRICS for p in ("previous_", "delta_from_previous_", "drop_from_previous_")]
    return rounded(_changes(spark, sf).select("case_id", "turn", *names))


@query(
    "attack_change_table",
    f"WITH {CHANGE_SQL} SELECT comparison_subset, attack_mode, {CHANGE_STATS} FROM changed GROUP BY 1, 2",
)
def attack_change_table(spark, sf):
    return rounded(at.attack_change_table(_changes(spark, sf), ["attack_mode"]))


@query(
    "attack_change_table_by_turns",
    f"""WITH {CHANGE_SQL} SELECT comparison_subset, turn_count, attack_mode, {CHANGE_STATS}
    FROM changed GROUP BY 1, 2, 3""",
)
def attack_change_table_by_turns(spark, sf):
    return rounded(at.attack_change_table(_changes(spark, sf), ["turn_count", "attack_mode"]))


# --- matched pairs ---------------------------------------------------------------

CORNERS = {
    "implicit_first": "attack_position = 'first_attack' AND attack_mode = 'implicit_attack'",
    "adversarial_first": "attack_position = 'first_attack' AND attack_mode = 'adversarial_attack'",
    "implicit_second": "attack_position = 'second_attack' AND attack_mode = 'implicit_attack'",
    "adversarial_second": "attack_position = 'second_attack' AND attack_mode = 'adversarial_attack'",
}
PAIR_SQL = f"""{ATTACK_SQL},
corners AS (
  SELECT order_average_group_id, arg_min(rule_count, case_id) AS rule_count,
    arg_min(turn_count, case_id) AS turn_count, arg_min(target_rule_id, case_id) AS target_rule_id,
    {", ".join(f"min(case_id) FILTER ({c}) AS {n}_case_id, " + ", ".join(f"arg_min_null({m}, case_id) FILTER ({c}) AS {n}_{m}" for m in fx.METRICS) for n, c in CORNERS.items())}
  FROM attack WHERE turn_count > 1 AND order_average_group_id IS NOT NULL GROUP BY 1),
whole AS (SELECT * FROM corners WHERE {" AND ".join(f"{n}_case_id IS NOT NULL" for n in CORNERS)})
"""


def _pair_sql(left: str, right: str, mode: str | None = None) -> str:
    head = f"'{mode}' AS attack_mode, " if mode else ""
    values = ", ".join(
        f"round({left}_{m}, 6) AS left_{m}, round({right}_{m}, 6) AS right_{m}, "
        f"round({right}_{m} - {left}_{m}, 6) AS right_minus_left_{m}"
        for m in fx.METRICS
    )
    return f"""SELECT order_average_group_id, rule_count, turn_count, target_rule_id, {head}
      {left}_case_id AS left_case_id, {right}_case_id AS right_case_id, {values} FROM whole"""


FIRST_PAIR = _pair_sql("implicit_first", "adversarial_first")
FINAL_PAIR = _pair_sql("adversarial_second", "implicit_second")
POSITION_PAIR = (
    _pair_sql("implicit_first", "implicit_second", "implicit_attack")
    + " UNION ALL "
    + _pair_sql("adversarial_first", "adversarial_second", "adversarial_attack")
)


def _corners(spark, sf):
    return at.pair_corners(attack_rows(spark, sf))


@query("matched_first_attack", f"WITH {PAIR_SQL} {FIRST_PAIR}")
def matched_first_attack(spark, sf):
    return rounded(at.matched_pairs(_corners(spark, sf), "first_attack"))


@query("matched_final_design", f"WITH {PAIR_SQL} {FINAL_PAIR}")
def matched_final_design(spark, sf):
    return rounded(at.matched_pairs(_corners(spark, sf), "final_design"))


@query("matched_position_effect", f"WITH {PAIR_SQL} {POSITION_PAIR}")
def matched_position_effect(spark, sf):
    return rounded(at.matched_pairs(_corners(spark, sf), "position_effect"))


@query(
    "incomplete_pair_groups",
    f"""WITH {PAIR_SQL} SELECT order_average_group_id, concat_ws('|',
      {", ".join(f"CASE WHEN {n}_case_id IS NULL THEN '{n}' END" for n in CORNERS)}) AS missing
    FROM corners WHERE order_average_group_id NOT IN (SELECT order_average_group_id FROM whole)""",
)
def incomplete_pair_groups(spark, sf):
    return at.incomplete_groups(_corners(spark, sf))


def _delta_sql(source: str, keys: str = "") -> str:
    names = [f"right_minus_left_{m}" for m in fx.METRICS]
    stats = ", ".join(
        f"round(avg({n}), 5) AS {n}_mean, round(stddev_pop({n}), 5) AS {n}_std, count({n}) AS {n}_n, "
        f"round(abs(avg({n})), 5) AS {n}_abs_mean"
        for n in names
    )
    group = f"GROUP BY {keys}" if keys else ""
    return f"WITH {PAIR_SQL}, p AS ({source}) SELECT {keys + ',' if keys else ''} {stats} FROM p {group}"


@query("first_attack_delta", _delta_sql(FIRST_PAIR))
def first_attack_delta(spark, sf):
    return rounded(at.delta_table(at.matched_pairs(_corners(spark, sf), "first_attack")), 5)


@query("final_design_delta", _delta_sql(FINAL_PAIR))
def final_design_delta(spark, sf):
    return rounded(at.delta_table(at.matched_pairs(_corners(spark, sf), "final_design")), 5)


@query("position_effect_delta", _delta_sql(POSITION_PAIR, "attack_mode"))
def position_effect_delta(spark, sf):
    pairs = at.matched_pairs(_corners(spark, sf), "position_effect")
    return rounded(at.delta_table(pairs, ["attack_mode"]), 5)


UNBALANCED_SQL = """
checked AS (
  SELECT order_average_group_id AS g, attack_order_variant AS v,
    target_rule_id || '|' || rule_count || '|' || turn_count || '|' || (case_id % 16) AS dims
  FROM records WHERE condition = 'injection_context' AND turn_count > 1),
unbalanced AS (
  SELECT g AS order_average_group_id, count(*) FILTER (v = 'implicit_then_adversarial') AS implicit_then_adversarial,
    count(*) FILTER (v = 'adversarial_then_implicit') AS adversarial_then_implicit, count(*) AS cases,
    0::BIGINT AS order_errors, count(DISTINCT dims) > 1 AS mixed_dimensions
  FROM checked GROUP BY 1
  HAVING NOT (implicit_then_adversarial = 1 AND adversarial_then_implicit = 1 AND cases = 2 AND NOT mixed_dimensions))
"""


def design_cases(spark, sf):
    """Design cases at scale: one per order, with the planned order of attack modes."""
    orders = F.create_map(
        *[x for k, v in fx.ORDER_VARIANTS.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in v]))]
    )
    return tb.run_records(spark, sf).withColumns(
        {
            "attack_order": F.try_element_at(orders, F.col("attack_order_variant")),
            "sampled_variant_id": (F.col("case_id") % 16).cast("string"),
        }
    )


@query("unbalanced_order_groups", f"WITH {tb.RECORDS_SQL}, {UNBALANCED_SQL} SELECT * FROM unbalanced")
def unbalanced_order_groups(spark, sf):
    return at.unbalanced_order_groups(design_cases(spark, sf))


@query(
    "order_effect_readiness",
    f"""WITH {PAIR_SQL}, {tb.RECORDS_SQL}, {UNBALANCED_SQL},
    fp AS ({FINAL_PAIR}), pp AS ({POSITION_PAIR}),
    s AS (SELECT
      (SELECT abs(avg(right_minus_left_perfect_success)) FROM fp) AS f,
      (SELECT max(v) FROM (SELECT abs(avg(right_minus_left_perfect_success)) AS v FROM pp GROUP BY attack_mode)) AS p,
      (SELECT count(*) FROM (SELECT case_id FROM cells WHERE method IN ('llm_judge', 'llm_language_judge')
        AND pass IS NULL AND NOT starts_with(detail, 'not applicable') GROUP BY case_id)) AS o,
      (SELECT count(*) FROM unbalanced) AS u,
      (SELECT count(*) FROM corners) - (SELECT count(*) FROM whole) AS i)
    SELECT round(f, 6) AS max_final_abs_delta, round(p, 6) AS max_position_abs_delta, o AS open_records,
      u AS unbalanced_groups, i AS incomplete_groups, greatest(f, p) <= 0.05 AS order_effect_negligible,
      o = 0 AND u = 0 AND i = 0 AS ready FROM s""",
)
def order_effect_readiness(spark, sf):
    corners = _corners(spark, sf)
    return rounded(
        at.readiness(
            at.matched_pairs(corners, "final_design"),
            at.matched_pairs(corners, "position_effect"),
            ce.unresolved_counts(tb.score_cells(spark, sf), ["case_id"]),
            at.unbalanced_order_groups(design_cases(spark, sf)),
            at.incomplete_groups(corners),
        )
    )


# --- collapse ------------------------------------------------------------------------

COLLAPSE_SQL = f"""{tb.TURNS_SQL},
hits AS (
  SELECT case_id, condition, rule_count, turn_count, e.event, e.metric, e.threshold,
    min(turn) FILTER (crossed) AS collapse_turn, arg_min(attack_mode, turn) FILTER (crossed) AS mode,
    arg_min(value, turn) FILTER (crossed) AS collapse_metric_value
  FROM (SELECT t.*, s.*, CASE s.event WHEN 'first_strict_failure' THEN perfect_success <= 0
        WHEN 'first_per_rule_below_0.8' THEN per_rule_pass_rate < 0.8 ELSE per_rule_pass_rate < 0.5 END AS crossed,
      CASE s.event WHEN 'first_strict_failure' THEN perfect_success ELSE per_rule_pass_rate END AS value
    FROM turns t, (VALUES ('first_strict_failure', 'perfect_success', 0.0::DOUBLE),
      ('first_per_rule_below_0.8', 'per_rule_pass_rate', 0.8::DOUBLE),
      ('first_per_rule_below_0.5', 'per_rule_pass_rate', 0.5::DOUBLE)) s(event, metric, threshold)) e
  GROUP BY ALL),
events_ AS (
  SELECT * EXCLUDE (mode), CASE WHEN collapse_turn IS NULL THEN 'none' ELSE mode END AS collapse_attack_mode,
    CASE WHEN collapse_turn IS NULL THEN 'none' WHEN mode = 'benign' THEN 'non_attack'
      WHEN turn_count = 1 THEN 'single_attack' WHEN collapse_turn = turn_count - 1 THEN 'first_attack'
      WHEN collapse_turn = turn_count THEN 'second_attack' ELSE 'attack_turn' END AS collapse_attack_position
  FROM hits)
"""


def _events(spark, sf):
    return at.collapse_events(turns_of(spark, sf), ["case_id", "condition", "rule_count", "turn_count"])


@query(
    "collapse_events",
    f"WITH {COLLAPSE_SQL} SELECT * REPLACE (round(collapse_metric_value, 6) AS collapse_metric_value) FROM events_",
)
def collapse_events(spark, sf):
    return rounded(_events(spark, sf))


@query(
    "collapse_table",
    f"""WITH {COLLAPSE_SQL}, t AS (SELECT event, condition, rule_count, turn_count, collapse_attack_mode,
      count(*) AS records, count(collapse_turn) AS collapsed_records, avg(collapse_turn) AS m
      FROM events_ GROUP BY 1, 2, 3, 4, 5)
    SELECT event, condition, rule_count, turn_count, collapse_attack_mode, records, collapsed_records,
      round(m, 6) AS mean_collapse_turn, round(collapsed_records / records, 6) AS collapse_rate,
      round(collapsed_records / sum(records) OVER (PARTITION BY event, condition, rule_count, turn_count), 6)
        AS collapse_share FROM t""",
)
def collapse_table(spark, sf):
    return rounded(at.collapse_table(_events(spark, sf)))


# --- profiles --------------------------------------------------------------------------


@query(
    "attack_target_drilldown",
    f"""WITH {tb.FINAL_CELLS_SQL}, r AS (SELECT case_id, temperature, any_value(attack_targets) AS ts,
      coalesce(avg(pass::INT), 1.0) AS old, coalesce(bool_and(pass), TRUE)::INT AS strict
      FROM final_cells WHERE attack_intensity = 'adversarial' GROUP BY 1, 2),
    t AS (SELECT *, unnest(ts) AS target FROM r),
    s AS (SELECT t.*, (SELECT bool_and(pass) FROM final_cells f WHERE f.case_id = t.case_id AND f.rule_id = t.target) AS ok
      FROM t)
    SELECT temperature, target AS attack_target_rule_id, count(ok) AS scorable_n,
      count(*) - count(ok) AS not_scorable_targets,
      round(avg(old) FILTER (ok IS NOT NULL), 6) AS old_per_rule_mean,
      round(avg(strict) FILTER (ok IS NOT NULL), 6) AS perfect_success_mean,
      round(avg(ok::INT), 6) AS attacked_rule_success_mean, count(*) FILTER (NOT ok) AS target_failed,
      count(*) FILTER (ok AND strict = 0) AS target_survived_other_failed,
      count(*) FILTER (ok AND strict = 1) AS all_rules_passed,
      ['language','format','format','behavior','behavior','persona','persona'][CAST(target[2:] AS INTEGER)]
        AS attack_target_type
    FROM s GROUP BY temperature, target""",
)
def attack_target_drilldown(spark, sf):
    counts = tb.final_counts(spark, sf, "attack_targets")
    return rounded(pf.attack_target_drilldown(counts, ["case_id"], tb.RULE_TYPES))


PROFILE_DIMS = ["temperature", "model", "attack_intensity", "rule_count", "turn_count", "o_orderstatus"]


@query(
    "run_profile_counts",
    f"""WITH {tb.RECORDS_SQL} """
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, count(*) AS n FROM records GROUP BY 2"
        for d in PROFILE_DIMS
    ),
)
def run_profile_counts(spark, sf):
    return pf.counts_by(tb.run_records(spark, sf), PROFILE_DIMS)


@query(
    "run_profile_methods",
    f"""WITH {tb.CELLS_SQL} SELECT method, CASE WHEN pass THEN 'pass' WHEN NOT pass THEN 'fail' ELSE 'na' END AS outcome,
      count(*) AS cells, count(*) FILTER (pass IS NULL AND contains(detail, 'not applicable')) AS none_not_applicable,
      count(*) FILTER (pass IS NULL AND NOT contains(detail, 'not applicable')) AS none_unresolved
    FROM cells GROUP BY 1, 2""",
)
def run_profile_methods(spark, sf):
    return pf.method_outcomes(tb.score_cells(spark, sf))


@query(
    "repetition_profile",
    """WITH r AS (SELECT o_custkey AS case_id, count(DISTINCT o_orderkey % 3) AS reps FROM orders GROUP BY 1)
    SELECT reps, count(*) AS cases FROM r GROUP BY 1""",
)
def repetition_profile(spark, sf):
    runs = tb.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 3).alias("rep")
    )
    return pf.repetition_profile(runs)


@query(
    "error_response_counts",
    """SELECT count(*) AS turns, count(*) FILTER (starts_with(response, '[ERROR]')) AS error_responses
    FROM (SELECT CASE WHEN conv_id % 7 = 0 THEN '[ERROR] ' || text ELSE text END AS response
      FROM conversations WHERE role = 'assistant')""",
)
def error_response_counts(spark, sf):
    rows = tb.responses(spark, sf).withColumn(
        "response",
        F.when(F.col("case_id") % 7 == 0, F.concat(F.lit("[ERROR] "), "response")).otherwise(F.col("response")),
    )
    return pf.error_responses(rows)


@query(
    "run_cell_counts",
    f"""WITH {tb.CELLS_SQL} SELECT case_id, count(*) FILTER (pass) AS passed, count(*) FILTER (NOT pass) AS failed,
      count(*) FILTER (pass IS NULL) AS na FROM cells GROUP BY 1""",
)
def run_cell_counts(spark, sf):
    return ce.cell_counts(tb.score_cells(spark, sf), ["case_id"])


@query(
    "bucket_composition",
    """WITH r AS (SELECT o_custkey AS case_id, o_orderkey % 3 AS rep, o_orderstatus AS attack_intensity,
      1 + 2 * (o_custkey % 4) AS rule_count, 1 + 2 * (o_custkey // 4 % 4) AS turn_count,
      o_orderpriority AS rule_set FROM orders)
    SELECT attack_intensity, rule_count, turn_count, rule_set, count(DISTINCT case_id) AS cases,
      count(*) AS runs, count(DISTINCT rep) AS reps FROM r GROUP BY 1, 2, 3, 4""",
)
def bucket_composition(spark, sf):
    cust = F.col("o_custkey")
    runs = tb.table(spark, sf, "orders").select(
        cust.alias("case_id"), (F.col("o_orderkey") % 3).alias("rep"),
        F.col("o_orderstatus").alias("attack_intensity"), (1 + 2 * (cust % 4)).alias("rule_count"),
        (1 + 2 * (F.floor(cust / 4) % 4)).alias("turn_count"), F.col("o_orderpriority").alias("rule_set"),
    )
    return pf.bucket_composition(runs)


@query(
    "representative_runs",
    f"""WITH {tb.FINAL_SQL}, c AS (SELECT *, avg(per_rule_pass_rate) OVER w AS cell_mean, count(*) OVER w AS cell_n
      FROM finals WINDOW w AS (PARTITION BY attack_intensity, rule_count, turn_count))
    SELECT attack_intensity, rule_count, turn_count, case_id, rep, round(per_rule_pass_rate, 6) AS per_rule_pass_rate,
      round(cell_mean, 6) AS cell_mean, cell_n FROM c
    QUALIFY row_number() OVER (PARTITION BY attack_intensity, rule_count, turn_count
      ORDER BY round(abs(per_rule_pass_rate - cell_mean), 9), case_id, rep) = 1""",
)
def representative_runs(spark, sf):
    picked = pf.representative_runs(tb.finals(spark, sf))
    return rounded(
        picked.select(
            "attack_intensity", "rule_count", "turn_count", "case_id", "rep", "per_rule_pass_rate",
            "cell_mean", "cell_n",
        )
    )


SHOWCASES = [
    {"name": "early", "attack": "adversarial", "rule_count": 5, "turn_count": 7, "first_failure_min": 2, "first_failure_max": 3},
    {"name": "late", "attack": "adversarial", "rule_count": 7, "turn_count": 7, "first_failure_min": 5, "first_failure_max": 7},
    {"name": "chosen", "attack": "benign", "rule_count": 3, "turn_count": 5, "first_failure_min": 1, "first_failure_max": 2,
     "preferred_case_id": 101, "preferred_rep": 2},
]


@query(
    "showcase_runs",
    f"""WITH {tb.FINAL_SQL}, f AS (SELECT case_id, min(turn) FILTER (NOT pass) AS first_failure_turn FROM cells GROUP BY 1),
    spec(showcase, a, r, t, lo, hi, pc, pr) AS (VALUES ('early', 'adversarial', 5, 7, 2, 3, NULL, NULL),
      ('late', 'adversarial', 7, 7, 5, 7, NULL, NULL), ('chosen', 'benign', 3, 5, 1, 2, 101, 2)),
    c AS (SELECT s.*, x.case_id, x.rep, f.first_failure_turn, x.per_rule_pass_rate, x.perfect_success,
        coalesce(x.case_id = s.pc AND x.rep = s.pr, FALSE) AS pref, coalesce(f.first_failure_turn, 999) AS ff
      FROM finals x LEFT JOIN f USING (case_id) JOIN spec s
        ON (x.case_id = s.pc AND x.rep = s.pr)
        OR (x.attack_intensity = s.a AND x.rule_count = s.r AND x.turn_count = s.t))
    SELECT showcase, case_id, rep, first_failure_turn FROM c
    QUALIFY row_number() OVER (PARTITION BY showcase ORDER BY pref DESC, (ff BETWEEN lo AND hi) DESC, ff,
      per_rule_pass_rate - perfect_success DESC, case_id, rep) = 1""",
)
def showcase_runs(spark, sf):
    firsts = ce.first_failed_turn(tb.score_cells(spark, sf), ["case_id"])
    picked = pf.showcase_runs(tb.finals(spark, sf), firsts, SHOWCASES, ["case_id"])
    return picked.select("showcase", "case_id", "rep", "first_failure_turn")


@query(
    "largest_run_matrix",
    f"""WITH {tb.CELLS_SQL}, best AS (SELECT case_id FROM (SELECT DISTINCT case_id, rule_count, turn_count, rep,
        attack_intensity FROM cells)
      WHERE turn_count >= 5 ORDER BY rule_count * turn_count DESC, case_id, rep LIMIT 1)
    SELECT case_id, turn, {", ".join(f"min(coalesce(pass::INT::DOUBLE, 0.5)) FILTER (rule_id = '{r}') AS {r}" for r in tb.RULE_IDS)}
    FROM cells WHERE case_id IN (SELECT case_id FROM best) GROUP BY 1, 2""",
)
def largest_run_matrix(spark, sf):
    cells = tb.score_cells(spark, sf)
    best = pf.largest_run(cells.select("case_id", "rep", "rule_count", "turn_count", "attack_intensity"))
    # ``best`` is a single row by its limit, so its broadcast cannot grow.
    chosen = cells.join(F.broadcast(best.select("case_id")), "case_id", "left_semi")
    return ce.status_matrix(chosen, tb.RULE_IDS, ["case_id"])


EXPECTED_TARGETS = ["R01", "R02", "R03", "R04", "R05", "R06", "R07", "R09", "R10"]


@query(
    "target_scope_check",
    f"""WITH {tb.RECORDS_SQL}, f AS (SELECT target_rule_id, count(*) AS records FROM records
      WHERE target_rule_id <> 'R07' GROUP BY 1 UNION ALL SELECT 'R99', 3),
    e(target_rule_id) AS (VALUES {", ".join(f"('{e}')" for e in EXPECTED_TARGETS)}),
    j AS (SELECT coalesce(f.target_rule_id, e.target_rule_id) AS target_rule_id, coalesce(records, 0) AS records,
      CASE WHEN f.target_rule_id IS NULL THEN 'missing' WHEN e.target_rule_id IS NULL THEN 'extra' ELSE 'present' END AS status
      FROM f FULL JOIN e ON f.target_rule_id = e.target_rule_id)
    SELECT *, (SELECT min(records) = max(records) FROM f) AS balanced FROM j""",
)
def target_scope_check(spark, sf):
    known = tb.run_records(spark, sf).filter(F.col("target_rule_id") != "R07").select("target_rule_id")
    extra = spark.range(3).select(F.lit("R99").alias("target_rule_id"))
    return pf.scope_check(known.unionByName(extra), EXPECTED_TARGETS)


@query(
    "design_trace_counts",
    f"""WITH {tb.RECORDS_SQL}, d AS (SELECT condition, rule_count, turn_count, attack_order_variant,
      'S' || (o_custkey % 10) AS sampled_variant_id, 'P' || (o_custkey % 35) AS possible_variant_id,
      target_rule_id AS active_rule_ids FROM records) """
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, count(*) AS n FROM d GROUP BY 2"
        for d in (
            "condition", "rule_count", "turn_count", "attack_order_variant", "sampled_variant_id",
            "possible_variant_id", "active_rule_ids",
        )
    ),
)
def design_trace_counts(spark, sf):
    cust = F.col("o_custkey")
    cases = tb.run_records(spark, sf).withColumns(
        {
            "sampled_variant_id": F.concat(F.lit("S"), (cust % 10).cast("string")),
            "possible_variant_id": F.concat(F.lit("P"), (cust % 35).cast("string")),
            "active_rule_ids": F.col("target_rule_id"),
        }
    )
    return pf.design_trace_counts(cases)


