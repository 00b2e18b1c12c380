import pytest
from pyspark.sql import functions as F

from holdfast.functions import fixed_values as fx
from holdfast.operators import attacks as at

SCHEMA = (
    "case_id int, turn int, turn_count int, rule_count int, target_rule_id string, condition string, attack_mode string, "
    "order_average_group_id string, per_rule_pass_rate double, perfect_success double, targeted_rule_success double, non_target_failure double"
)


def pair(group, first_case, weak, strong):
    """Two cases of one group; weak / strong = (as first, as second) partial credit."""
    rows = []
    for case, modes in ((first_case, ("implicit_attack", "strong_pressure")), (first_case + 1, ("strong_pressure", "implicit_attack"))):
        for turn in (1, 2, 3):
            rows.append((case, turn, 5, 3, "R1", "injection_context", "benign", group, 1.0, 1.0, None, None))
        for turn, mode, slot in ((4, modes[0], 0), (5, modes[1], 1)):
            value = (weak if mode == "implicit_attack" else strong)[slot]
            rows.append((case, turn, 5, 3, "R1", "injection_context", mode, group, value, 0.0, 1.0, 0.0))
    return rows


@pytest.fixture
def turns(spark):
    data = pair("g1", 1, (1.0, 0.75), (0.5, 0.25)) + pair("g2", 11, (0.5, 0.5), (0.5, 0.5))[:5]
    data.append((99, 1, 1, 1, "R1", "injection_context", "implicit_attack", "g9", 1.0, 1.0, 1.0, None))
    return spark.createDataFrame(data, SCHEMA)


def test_positions(turns):
    rows = at.attack_turns(turns)
    got = {(r.case_id, r.turn): (r.attack_mode, r.attack_position) for r in rows.collect()}
    assert got[1, 4] == ("implicit_attack", "first_attack") and got[1, 5] == ("adversarial_attack", "second_attack")
    assert got[99, 1][1] == "single_attack" and len(got) == 7


def test_previous_turn_must_be_the_one_before(turns):
    gap = turns.filter("not (case_id = 1 and turn = 3)")
    changed = at.with_previous_turn(at.attack_turns(gap), gap, ["case_id"])
    got = {(r.case_id, r.turn): r.delta_from_previous_per_rule_pass_rate for r in changed.collect()}
    assert got[1, 4] is None and got[1, 5] == -0.75 and got[2, 4] == -0.5 and got[99, 1] is None


def test_matched_pairs(turns):
    corners = at.pair_corners(at.attack_turns(turns))
    first = at.matched_pairs(corners, "first_attack").collect()
    assert len(first) == 1 and first[0].right_minus_left_per_rule_pass_rate == -0.5
    assert first[0].right_minus_left_perfect_success == 0.0 and (first[0].left_case_id, first[0].right_case_id) == (1, 2)
    final = at.matched_pairs(corners, "final_design").collect()[0]
    assert final.right_minus_left_per_rule_pass_rate == 0.5
    position = {r.attack_mode: r.right_minus_left_per_rule_pass_rate for r in at.matched_pairs(corners, "position_effect").collect()}
    assert position == {"implicit_attack": -0.25, "adversarial_attack": -0.25}
    missing = at.incomplete_groups(corners).collect()
    assert [(r.order_average_group_id, r.missing) for r in missing] == [("g2", "adversarial_first|implicit_second")]
    overall = at.delta_table(at.matched_pairs(corners, "position_effect")).collect()[0]
    assert overall.right_minus_left_per_rule_pass_rate_abs_mean == 0.25 and overall.right_minus_left_per_rule_pass_rate_n == 2


def test_subsets_overlap(turns):
    rows = at.with_subsets(at.attack_turns(turns), positions=True)
    got = {r.comparison_subset: r["count"] for r in rows.groupBy("comparison_subset").count().collect()}
    assert got == {"all_attack_turns": 7, "paired_T5_T10_T15": 6, "first_attack_only": 3, "second_attack_only": 3}


def test_collapse_events(turns):
    got = {(r.case_id, r.event): r for r in at.collapse_events(turns, ["case_id", "condition", "rule_count", "turn_count"]).collect()}
    strict = got[1, "first_strict_failure"]
    assert (strict.collapse_turn, strict.collapse_attack_mode, strict.collapse_attack_position) == (4, "implicit_attack", "first_attack")
    severe = got[1, "first_per_rule_below_0.5"]
    assert (severe.collapse_turn, severe.collapse_attack_mode, severe.collapse_metric_value) == (5, "adversarial_attack", 0.25)
    none = got[99, "first_strict_failure"]
    assert none.collapse_turn is None and none.collapse_attack_mode == "none" and none.collapse_attack_position == "none"


def test_collapse_share_is_not_degenerate(turns):
    events = at.collapse_events(turns, ["case_id", "condition", "rule_count", "turn_count"])
    rows = at.collapse_table(events).filter("event = 'first_per_rule_below_0.5' and turn_count = 5").collect()
    shares = {r.collapse_attack_mode: r.collapse_share for r in rows}
    assert shares["adversarial_attack"] == pytest.approx(1 / 3) and shares["none"] == 0


def test_order_balance(spark):
    orders = fx.ORDER_VARIANTS
    good = [(i, "g", v, m, "R1") for i, (v, m) in enumerate(orders.items())]

    def bad(data):
        df = spark.createDataFrame(data, "case_id int, order_average_group_id string, attack_order_variant string, attack_order array<string>, target_rule_id string")
        df = df.withColumns({"condition": F.lit("injection_context"), "turn_count": F.lit(5), "rule_count": F.lit(3), "sampled_variant_id": F.lit("S")})
        return [r.order_average_group_id for r in at.unbalanced_order_groups(df).collect()]

    assert bad(good) == []
    assert bad(good[:1]) == ["g"]
    assert bad([*good, (3, *good[0][1:])]) == ["g"]
    assert bad([good[0], (*good[1][:3], good[0][3], "R1")]) == ["g"]
    assert bad([good[0], (*good[1][:4], "R2")]) == ["g"]
