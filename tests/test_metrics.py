import pytest
from pyspark.sql import functions as F

from holdfast.operators import cells as ce
from holdfast.operators import conditions as co
from holdfast.operators import failures as fl
from holdfast.operators.common import first_n_per_key, running_count

SCORE = "array<struct<rule_id:string,pass:boolean>>"
# (cells, targets, per_rule, strict, targeted, non_target)
TABLE = [
    ([("R01", True), ("R03", False), ("R04", None)], [], 0.5, 0.0, None, None),
    ([("R01", True), ("R04", None)], [], 1.0, 1.0, None, None),
    ([("R04", None)], [], 1.0, 1.0, None, None),
    ([("R01", False), ("R03", True), ("R07", True)], ["R03", "R07"], 2 / 3, 0.0, 1.0, 1.0),
    ([("R01", False), ("R03", True), ("R07", True)], ["R04"], 2 / 3, 0.0, None, 1.0),
    ([("R01", False), ("R03", True), ("R04", None), ("R07", True)], ["R01"], 2 / 3, 0.0, 0.0, 0.0),
    ([("R03", True), ("R04", None)], ["R03"], 1.0, 1.0, 1.0, None),
    ([("R01", True), ("R03", False), ("R05", False), ("R04", None)], ["R03"], 1 / 3, 0.0, 0.0, 1.0),
    ([("R01", False)], [""], 0.0, 0.0, None, None),
    ([("R01", False), ("R02", True)], ["R01", "R01"], 0.5, 0.0, 0.0, 0.0),
]
EXPECTED = [tuple(r[2:]) for r in TABLE]
NAMES = ["per_rule_pass_rate", "perfect_success", "targeted_rule_success", "non_target_failure"]


def turns(spark, table=TABLE):
    data = [(i, cells, targets) for i, (cells, targets, *_rest) in enumerate(table)]
    return spark.createDataFrame(data, f"turn int, scores {SCORE}, attack_targets array<string>")


def check(got):
    for row, want in zip(sorted(got, key=lambda r: r["turn"]), EXPECTED):
        for name, value in zip(NAMES, want):
            assert row[name] == (pytest.approx(value) if value is not None else None), (row, name)


def test_grouped_metrics_match_the_truth_table(spark):
    cells = ce.with_target_flags(ce.explode_cells(turns(spark)))
    check(ce.turn_metrics(cells, ["turn"]).collect())


def test_nested_metrics_match_the_truth_table(spark):
    check(ce.turn_metrics_nested(turns(spark)).collect())


def test_nested_metrics_of_a_turn_without_cells(spark):
    row = ce.turn_metrics_nested(turns(spark, [([], ["R01"])])).collect()[0]
    assert (row.per_rule_pass_rate, row.perfect_success) == (1.0, 1.0)
    assert row.targeted_rule_success is None and row.non_target_failure is None


def test_first_failure_is_kept_after_recovery(spark):
    data = [("a", "R1", t, p) for t, p in [(1, True), (2, False), (3, True), (4, False)]]
    data += [("b", "R1", 1, True), ("c", "R1", 1, None)]
    cells = spark.createDataFrame(data, "case_id string, rule_id string, turn int, pass boolean")
    got = {r.case_id: r.first_failure_turn for r in ce.first_failures(cells, ["case_id", "rule_id"]).collect()}
    assert got == {"a": 2, "b": None}


def test_final_turn_is_the_highest_not_the_last_row(spark):
    data = [("a", 3, 0.3), ("a", 1, 0.1), ("a", 2, 0.2)]
    df = spark.createDataFrame(data, "case_id string, turn int, v double")
    assert ce.final_turn(df, ["case_id"], ["v"]).collect()[0].v == 0.3


def test_condition_table_separates_temperatures_and_reports_the_gap(spark):
    data = [(0.0, 3, 1, "benign", 2 / 3, 0.0, None, None), (0.0, 3, 1, "benign", 1.0, 1.0, 1.0, None),
            (0.7, 3, 1, "benign", 1.0, 1.0, None, None)]
    df = spark.createDataFrame(
        data, "temperature double, rule_count int, turn_count int, attack_intensity string, " + ", ".join(f"{n} double" for n in NAMES)
    )
    got = {r.temperature: r for r in co.condition_table(df).collect()}
    assert got[0.0].n == 2 and got[0.0].per_rule_pass_rate_mean == pytest.approx(5 / 6)
    assert got[0.0].gap_pp == pytest.approx(33.3333, abs=1e-3)
    assert got[0.0].targeted_rule_success_n == 1 and got[0.0].non_target_failure_mean is None
    assert got[0.7].perfect_success_std == 0.0


def test_first_failure_summary_uses_linear_quantiles(spark):
    data = [("x", t) for t in (1, 2, 3, 10, None)]
    df = spark.createDataFrame(data, "k string, first_failure_turn int")
    row = fl.first_failure_summary(df, ["k"]).collect()[0]
    assert (row.trajectories, row.failed_trajectories, row.failure_rate) == (5, 4, 0.8)
    assert row.median_first_failure_turn == 2.5
    assert row.p25_first_failure_turn == pytest.approx(1.75)
    assert row.p75_first_failure_turn == pytest.approx(4.75)
    assert (row.min_first_failure_turn, row.max_first_failure_turn) == (1, 10)


def test_first_failure_summary_without_any_failure(spark):
    df = spark.createDataFrame([("x", None)], "k string, first_failure_turn int")
    row = fl.first_failure_summary(df, ["k"]).collect()[0]
    assert row.failed_trajectories == 0 and row.failure_rate == 0 and row.mean_first_failure_turn is None


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_running_count_does_not_depend_on_blocks(spark, block):
    data = [(k, i, (i * 7 + len(k)) % 3 == 0) for k in ("a", "bb") for i in range(0, 40, 1 + len(k))]
    df = spark.createDataFrame(data, "k string, i int, hit boolean")
    got = running_count(df, ["k"], "i", F.col("hit"), "n", block).collect()
    for row in got:
        assert row.n == sum(h for k, i, h in data if k == row.k and i <= row.i)


def test_first_n_per_key_above_the_planner_limit_equals_brute_force(spark):
    df = spark.range(20000).select((F.col("id") % 2).alias("k"), ((F.col("id") * 7919) % 20011).alias("v"))
    got = {(r.k, r.v) for r in first_n_per_key(df, ["k"], [F.col("v")], 1500).collect()}
    want = set()
    for k in (0, 1):
        ranked = sorted((i * 7919) % 20011 for i in range(20000) if i % 2 == k)
        want |= {(k, v) for v in ranked[:1500]}
    assert got == want


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = first_n_per_key(df, ["k"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("n", [1, 1000, 1001])
@pytest.mark.parametrize("down", [False, True])
def test_first_n_is_one_plan_for_every_n(spark, n, down):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    order = F.col("v").desc() if down else F.col("v").asc()
    got = {(r.k, r.v) for r in first_n_per_key(df, ["k"], [order], n).collect()}
    values = sorted(range(5000), reverse=down)
    assert got == {(k, v) for k in (0, 1) for v in [x for x in values if x % 2 == k][:n]}
