import json

import pytest
from pyspark.sql import functions as F

from holdfast.functions import verdicts as vd
from holdfast.operators import judging as jd

RULE = [
    ('{"pass": true, "reason": "ok"}', True, "ok"),
    ('{"pass": false, "reasoning": "legacy"}', False, "legacy"),
    ('```json\n{"pass": true, "reason": "f"}\n```', True, "f"),
    ('I say {"pass": false, "reason": "inside"} done', False, "inside"),
    ('{"applicable": false, "pass": true, "reason": "no trigger"}', None, "not applicable: no trigger"),
    ('{"applicable": "", "pass": true, "reason": "r"}', None, "not applicable: r"),
    ('{"pass": "false"}', True, ""),
    ('{"pass": 0}', False, ""),
    ('{"pass": null}', False, ""),
    ('broken "pass": true {', True, 'fallback_parse: broken "pass": true {'),
    ('broken "pass":false', False, 'fallback_parse: broken "pass":false'),
    ("no idea", None, "parse_error: no idea"),
    ("", None, "empty judge response"),
    (None, None, "empty judge response"),
    ("[1, 2]", None, "parse_error: [1, 2]"),
]


@pytest.mark.parametrize("raw,passed,detail", RULE)
def test_rule_verdict(spark, raw, passed, detail):
    got = spark.range(1).select(vd.rule_verdict(F.lit(raw).cast("string")).alias("v")).collect()[0].v
    assert got["pass"] is passed and got["detail"] == detail


TASK = [
    ('{"score": 1, "verdict": "PASS", "reasoning": "r"}', "PASS", 1),
    ('```\n{"score": 0, "verdict": "FAIL"}\n```', "FAIL", 0),
    ('so {"verdict": "PASS", "score": 1} end', "PASS", 1),
    ("it does pass", "PASS", 1),
    ("pass or fail?", "FAIL", 0),
    ("hm", "PARSE_ERROR", 0),
]


@pytest.mark.parametrize("raw,verdict,score", TASK)
def test_task_verdict(spark, raw, verdict, score):
    got = spark.range(1).select(vd.task_verdict(F.lit(raw)).alias("v")).collect()[0].v
    assert (got["verdict"], got["score"]) == (verdict, score)


def test_batch_verdicts(spark):
    raw = 'x ```json\n{"results": [{"item_id": "a", "pass": "yes", "reason": "' + "r" * 130 + '"}, {"item_id": "b", "applicable": 0, "pass": true}, {"item_id": ""}, 7]}\n```'
    got = spark.range(1).select(vd.batch_verdicts(F.lit(raw)).alias("v")).collect()[0].v
    assert [(r["item_id"], r["applicable"], r["pass"]) for r in got] == [("a", True, True), ("b", False, True)]
    assert len(got[0]["reasoning"]) == 120


def test_column_verdict_recomputes_the_flag(spark):
    raw = '{"perfect_success": true, "non_target_failure": false, "failed_rules": ["R02 ", ""], "reason": "x"}'
    got = spark.range(1).select(vd.column_verdict(F.lit(raw), F.lit("R01")).alias("v")).collect()[0].v
    assert got["non_target_failure"] is True and got["failed_rules"] == ["R02"] and got["perfect_success"] is True
    assert spark.range(1).select(vd.column_verdict(F.lit("nothing"), F.lit("R01")).alias("v")).collect()[0].v is None


def test_notes(spark):
    note = vd.append_note(F.lit(" old "), vd.suggestion_note(F.array().cast("array<string>"), F.lit("why")))
    assert spark.range(1).select(note.alias("n")).collect()[0].n == "old | SUGGESTED failed_rules=none; reason=why"


def test_requests_are_full_and_in_order(spark):
    """A record with many open slots, a null key and an empty queue."""
    rows = [("a", 0, None, t, s, f"R{r}", "behavioral", f"rule {r}", None if t == 1 else 'say "x"\n', f"reply {t}")
            for t in range(1, 9) for s in (0, 1) for r in (1, 2, 3)] + [("b", 0, 0.5, 2, 0, "R1", "language", None, "u", "")]
    names = "case_id rep temperature turn score_index rule_id kind rule_text user_message response".split()
    schema = ("case_id string, rep int, temperature double, turn int, score_index int, rule_id string, kind string, "
              "rule_text string, user_message string, response string")
    queue = spark.createDataFrame(rows, schema).withColumn("item_id", jd.item_id("turn", "score_index", "rule_id"))
    keys = ["case_id", "rep", "temperature"]
    got = {(r.case_id, r.request_part): r for r in jd.batch_requests(queue, 10, keys).collect()}
    assert {k: r["items"] for k, r in got.items()} == {
        ("a", 0): 10, ("a", 1): 10, ("a", 2): 10, ("a", 3): 10, ("a", 4): 8, ("b", 0): 1}
    sent = [x for part in range(5) for x in json.loads(got["a", part].items_json)]
    want = [dict(zip(names, r, strict=True)) for r in rows if r[0] == "a"]
    assert [x["item_id"] for x in sent] == [f"t{w['turn']}_s{w['score_index']}_{w['rule_id']}" for w in want]
    assert [(x.get("user_message"), x["assistant_response"], x["rule_text"]) for x in sent] == [
        (w["user_message"], w["response"], w["rule_text"]) for w in want]
    assert jd.batch_requests(queue.filter("false"), 10, keys).collect() == []
