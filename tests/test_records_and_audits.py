from pyspark.sql import functions as F

from holdfast.operators import audits as au
from holdfast.operators import judging as jd
from holdfast.operators import profiles as pf
from holdfast.operators import records as rc
from holdfast.operators import review_labels as rv
from holdfast.operators import transform_report as tr

KEY = "case_id string, rep int, model string, temperature double"


def test_dedupe_prefers_rules_then_turns_then_first_seen(spark):
    data = [
        ("a", 0, "m", 0.0, False, 9, 1), ("a", 0, "m", 0.0, True, 2, 2), ("a", 0, "m", 0.0, True, 3, 3), ("a", 0, "m", 0.0, True, 3, 4),
        ("a", 0, "m", 0.7, True, 1, 5), ("a", 1, "m", 0.0, True, 1, 6),
    ]
    df = spark.createDataFrame(data, f"{KEY}, rules boolean, turns int, ord int")
    once = rc.dedupe_records(df, F.col("rules"), F.col("turns"), "ord")
    assert sorted(r.ord for r in once.collect()) == [3, 5, 6]
    twice = rc.dedupe_records(once, F.col("rules"), F.col("turns"), "ord")
    assert sorted(r.ord for r in twice.collect()) == [3, 5, 6]


def test_enrich_turn_targets(spark):
    turns = spark.createDataFrame(
        [("a", 1, [], None), ("a", 2, None, "benign"), ("a", 3, ["X"], "strong_pressure"), ("b", 1, None, None)],
        "case_id string, turn int, attack_targets array<string>, attack_mode string",
    ).withColumn("rule_count", F.lit(1))
    meta = spark.createDataFrame(
        [("a", t, ["R1"], "implicit_attack") for t in (1, 2, 3)], "case_id string, turn int, attack_targets array<string>, attack_mode string"
    )
    cases = spark.createDataFrame([("a", 5)], "case_id string, rule_count int")
    loose = {(r.case_id, r.turn): (r.attack_targets, r.attack_mode) for r in rc.enrich_turns(turns, cases, meta).collect()}
    assert loose == {("a", 1): ([], "implicit_attack"), ("a", 2): (["R1"], "benign"), ("a", 3): (["X"], "strong_pressure"), ("b", 1): ([], "")}
    rows = rc.enrich_turns(turns, cases, meta, strict=True, overwrite=["rule_count"]).collect()
    strict = {(r.case_id, r.turn): (r.attack_mode, r.rule_count) for r in rows}
    assert strict == {("a", 1): ("implicit_attack", 5), ("a", 2): ("implicit_attack", 5), ("a", 3): ("adversarial_attack", 5), ("b", 1): ("", 1)}


def test_remaining_requests_need_usable_text(spark):
    plan = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "request_id string")
    seen = spark.createDataFrame([("a", "ok", "x"), ("b", "ok", " 　"), ("c", "error", "x")], "request_id string, status string, response string")
    assert sorted(r.request_id for r in rc.remaining_requests(plan, seen).collect()) == ["b", "c", "d"]


LABELS = [
    # action, reason, applicable, pass, judge -> action, applicable, pass
    (("", "", "", "", "TRUE"), ("keep", "TRUE", "TRUE")),
    (("why", "override", "", "FALSE", "TRUE"), ("override", "TRUE", "FALSE")),
    (("", "x", "", "FALSE", "TRUE"), ("override", "TRUE", "FALSE")),
    (("", "x", "", "TRUE", "TRUE"), ("keep", "", "TRUE")),
    (("keep", "", "", "", "FALSE"), ("keep", "", "FALSE")),
    (("exclude", "x", "", "TRUE", "TRUE"), ("exclude", "FALSE", "NA")),
    (("keep", "", "false", "TRUE", "TRUE"), ("exclude", "FALSE", "NA")),
    (("unsure", "", "", "", "TRUE"), ("unsure", "", "")),
]


def labels(spark):
    data = [(f"r{i}", *given) for i, (given, _w) in enumerate(LABELS)]
    return spark.createDataFrame(data, "review_id string, human_action string, human_reason string, human_applicable string, human_pass string, judge_pass string")


def test_label_normalisation(spark):
    got = {r.review_id: r for r in au.normalize_labels(labels(spark)).collect()}
    for i, (_g, want) in enumerate(LABELS):
        row = got[f"r{i}"]
        assert (row.action, row.applicable, row.human_pass_norm) == want, i
    assert got["r1"].was_shifted and got["r1"].reason == "why"
    assert got["r0"].label_status == "inferred_keep_from_blank" and got["r7"].action_flag == "unsure"
    assert au.label_violations(au.normalize_labels(labels(spark))).count() == 0


def test_human_audit_is_null_safe(spark):
    cells = spark.createDataFrame(
        [("a", 1, "R1", True, "d"), ("a", 1, "R2", None, "d"), ("a", 2, "R1", False, "d"), ("a", 3, "R1", True, "d")],
        "case_id string, turn int, rule_id string, pass boolean, detail string",
    )
    audit = spark.createDataFrame(
        [("a", 1, "R1", "x", "exclude", "FALSE", "NA", "n"), ("a", 1, "R2", "y", "exclude", "FALSE", "NA", "n"),
         ("a", 2, "R1", "z", "override", "TRUE", "TRUE", "ok")],
        "case_id string, turn int, rule_id string, review_id string, action string, applicable string, human_pass_norm string, reason string",
    )
    got = {(r.turn, r.rule_id): r for r in au.apply_human_audit(cells, audit).collect()}
    assert got[1, "R1"]["pass"] is None and got[1, "R1"].changed and got[1, "R1"].judge_pass_before is True
    assert got[1, "R2"].reviewed and not got[1, "R2"].changed
    assert got[2, "R1"]["pass"] is True and got[2, "R1"].detail == "human_adjusted[override]: ok | original: d"
    assert not got[3, "R1"].reviewed and got[3, "R1"]["pass"] is True


def test_policy_decisions(spark):
    ko = "가" * 40
    data = [
        ("R01", False, "x", "u", ko, "override", "TRUE"), ("R01", False, "x", "u", "english", "keep", "FALSE"),
        ("R09", False, "Answer CUT OFF", "u", "r", "override", "TRUE"), ("R09", False, "wrong fact", "u", "r", "keep", "FALSE"),
        ("R04", True, "x", "hi", "hello", "exclude", "NA"), ("R04", True, "x", "my email", "hello", "keep", "TRUE"),
        ("R06", None, "not applicable", "u", "r", "keep", "NA"),
    ]
    df = spark.createDataFrame([(*d, "llm_judge") for d in data], "rule_id string, pass boolean, detail string, user_message string, response string, want string, adj string, method string")
    for row in au.policy_candidates(df).collect():
        assert (row.policy_action, row.adjusted_pass) == (row.want, row.adj), row
    applied = {(r.rule_id, r.detail): r["pass"] for r in au.apply_policy(df).collect()}
    assert applied["R04", "not applicable: excluded by audit policy"] is None
    assert applied["R09", "audit adjusted from FALSE to TRUE"] is True


SLOT = "case_id string, rep int, model string, temperature double, turn int, score_index int, rule_id string"


def test_replay_takes_the_latest_and_ignores_unknown_slots(spark):
    cells = spark.createDataFrame(
        [("a", 0, "m", 0.0, 1, 0, "R1", "llm_judge", None, "pending"), ("a", 0, "m", 0.0, 1, 1, "R2", "auto_regex", True, "k")],
        f"{SLOT}, method string, pass boolean, detail string",
    )
    log = spark.createDataFrame(
        [("a", 0, "m", 0.0, 1, 0, "R1", False, "old", 1), ("a", 0, "m", 0.0, 1, 0, "R1", True, "new", 2),
         ("a", 0, "m", 0.0, 1, 1, "R2", False, "not a judge slot", 3), ("zz", 0, "m", 0.0, 1, 0, "R1", False, "unknown", 4)],
        f"{SLOT}, pass boolean, detail string, ord int",
    )
    got = {r.rule_id: r for r in jd.replay_checkpoints(cells, log, "ord").collect()}
    assert len(got) == 2 and got["R1"]["pass"] is True and got["R1"].detail == "new"
    assert got["R2"]["pass"] is True and not got["R2"].restored


def test_queue_and_merge(spark):
    cells = spark.createDataFrame(
        [("a", 0, "m", 0.0, 1, 0, "R01", "llm_language_judge", None, "pending"), ("a", 0, "m", 0.0, 1, 1, "R04", "llm_judge", None, "Not applicable: x"),
         ("a", 0, "m", 0.0, 1, 2, "R05", "llm_judge", True, "ok"), ("a", 0, "m", 0.0, 1, 3, "R02", "auto_char_count", None, "")],
        f"{SLOT}, method string, pass boolean, detail string",
    )
    queue = jd.judge_queue(cells).collect()
    assert [(r.item_id, r.kind) for r in queue] == [("t1_s0_R01", "language")]
    assert jd.judge_queue(cells, force=True).count() == 3
    verdicts = spark.createDataFrame([("a", 1, 0, False, True, "w" * 90)], "case_id string, turn int, score_index int, applicable boolean, pass boolean, reasoning string")
    got = {r.score_index: r for r in jd.merge_verdicts(cells, verdicts, ["case_id", "turn", "score_index"]).collect()}
    assert got[0]["pass"] is None and got[0].detail == "not applicable: " + "w" * 80
    assert got[2]["pass"] is True and not got[2].judged


def test_prompt_filling_does_not_fill_twice(spark):
    prompt = jd.fill("A {x} B {y}", x=F.lit("{y}"), y=F.lit("2"))
    assert spark.range(1).select(prompt.alias("p")).collect()[0].p == "A {y} B 2"


def test_label_repair(spark):
    data = [("a", "", "TRUE", "FALSE", ""), ("b", "t", "0", "no", "n"), ("c", "TRUE", "TRUE", "yes", ""), ("d", "maybe", "TRUE", "FALSE", ""), ("e", "f", "F", "F", "")]
    df = spark.createDataFrame(data, "request_id string, human_target_rule_pass string, human_perfect_success string, human_non_target_failure string, human_notes string")
    got = {r.request_id: r for r in rv.repair_labels(df).collect()}
    assert got["a"].human_target_rule_pass == "TRUE" and not got["a"].repaired
    assert got["b"].human_perfect_success == "TRUE" and got["b"].human_notes.startswith("n; CONSISTENCY_FIX")
    assert got["c"].human_perfect_success == "FALSE" and got["d"].unresolved and not got["e"].repaired


def test_scope_check(spark):
    df = spark.createDataFrame([("R1",), ("R1",), ("R2",), ("R9",)], "target_rule_id string")
    got = {r.target_rule_id: (r.records, r.status, r.balanced) for r in pf.scope_check(df, ["R1", "R2", "R3"]).collect()}
    assert got == {"R1": (2, "present", False), "R2": (1, "present", False), "R3": (0, "missing", False), "R9": (1, "extra", False)}


def test_representative_run_ties_go_to_the_lower_case(spark):
    data = [("b", 0, 0.4), ("a", 1, 0.6), ("a", 0, 0.6), ("c", 0, 0.0), ("d", 0, 1.0)]
    df = spark.createDataFrame(data, "case_id string, rep int, per_rule_pass_rate double").withColumns(
        {"attack_intensity": F.lit("x"), "rule_count": F.lit(1), "turn_count": F.lit(1)}
    )
    row = pf.representative_runs(df).collect()[0]
    assert (row.case_id, row.rep, row.cell_n) == ("a", 0, 5)


def test_defense_effect_without_baseline(spark):
    rates = spark.createDataFrame([("none", 5, 0.5), ("w", 5, 0.75), ("w", 9, 0.5), ("none", 7, 1.0), ("w", 7, 0.5)], "variant string, turn_count int, compliance_rate double")
    got = {r.turn_count: r for r in tr.defense_effect(rates).collect()}
    assert (got[5].defense_effectiveness, got[5].compliance_preservation) == (0.5, 1.5)
    assert (got[9].baseline_rate, got[9].defense_effectiveness, got[9].compliance_preservation) == (0.0, 0.5, 0.0)
    assert got[7].defense_effectiveness == 0.0


def test_total_tokens(spark):
    df = spark.createDataFrame([(5, ["a b"]), (0, ["a b", None, "c"]), (None, [])], "t int, m array<string>")
    assert [r.x for r in df.select(rc.total_tokens("t", "m").alias("x")).collect()] == [5, 3, 0]
