import json

import pytest
from pyspark.sql import functions as F

from holdfast import schemas as sc
from holdfast.operators import cells as ce
from holdfast.sources import json_array as ja
from holdfast.sources import readers as rd
from holdfast.sources import writers as wr


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines), encoding="utf-8")
    return str(path)


def record(case, turns, **more):
    return {"case_id": case, "rep": 0, "model": "m", "turn_results": turns, **more}


def test_run_records_with_blank_and_broken_lines(spark, tmp_path):
    turn = {"turn": 1, "response": "안녕 😊", "scores": [{"rule_id": "R1", "pass": None, "method": "x", "detail": "d"}, {"rule_id": "R2", "pass": False}]}
    path = write(tmp_path / "r" / "a.jsonl", [record("a", [turn]), "", "  ", record("b", [], temperature=0.7), "{broken", record("c", [], generation_config={"temperature": 0.2})])
    rows = rd.read_run_records(spark, path)
    assert {r.case_id: r.temperature for r in rows.collect()} == {"a": 0.0, "b": 0.7, "c": 0.2}
    assert [r.case_id for r in rows.orderBy("ingest_ord").collect()] == ["a", "b", "c"]
    raw = rd.read_json_lines(spark, path, sc.RUN_RECORD)
    assert [r[0] for r in rd.quarantined(raw.cache()).collect()] == ["{broken"]
    cells = ce.explode_cells(ce.explode_turns(rows.select("case_id", "turn_results")).select("case_id", "turn", "scores"))
    assert [(r.score_index, r.rule_id, r["pass"]) for r in cells.orderBy("score_index").collect()] == [(0, "R1", None), (1, "R2", False)]


def test_preferred_paths(spark, tmp_path):
    write(tmp_path / "results_a.jsonl", [{}])
    pick = lambda: rd.preferred_paths(spark, f"{tmp_path}/fast_results_*.jsonl", f"{tmp_path}/results_*.jsonl")
    assert [p.rsplit("/", 1)[1] for p in pick()] == ["results_a.jsonl"]
    write(tmp_path / "fast_results_b.jsonl", [{}])
    assert [p.rsplit("/", 1)[1] for p in pick()] == ["fast_results_b.jsonl"]
    assert rd.preferred_paths(spark, "x", "y", [f"{tmp_path}/none*"]) == []


def test_result_tree_takes_names_from_folders(spark, tmp_path):
    write(tmp_path / "modelA" / "window_3" / "results.jsonl", [{"case_id": "a"}])
    write(tmp_path / "modelB" / "none" / "results.jsonl", [{"case_id": "b"}])
    write(tmp_path / "modelB" / "none" / "other.jsonl", [{"case_id": "c"}])
    got = {(r.model_name, r.variant_name, r.case_id) for r in rd.read_result_tree(spark, str(tmp_path), "case_id string").collect()}
    assert got == {("modelA", "window_3", "a"), ("modelB", "none", "b")}


def test_cases_to_turn_metadata(spark, tmp_path):
    template = [{"turn": 1, "role": "user", "attack_targets": [], "attack_mode": "benign"}, {"turn": 2, "attack_targets": ["R1"], "attack_mode": "x", "attack_type": "strong_pressure"}]
    path = write(tmp_path / "cases.jsonl", [{"case_id": "a", "conversation_template": template, "filler_category_composition": {"format": 2}}])
    cases = rd.read_cases(spark, path)
    assert cases.collect()[0].filler_category_composition == {"format": 2}
    got = {r.turn: (r.attack_targets, r.attack_mode) for r in rd.case_turns(cases).collect()}
    assert got == {1: ([], "benign"), 2: (["R1"], "adversarial_attack")}


def test_attack_prompt_csv_with_mark_quotes_and_newlines(spark, tmp_path):
    header = ",".join(sc.PROMPT_COLUMNS)
    cells = ["p1", "final", "R01", "c", "1", "n", "s", "single_rule", '"한국어, ""인용"" 줄\n둘"', "t", "f", "a", "yes", ""]
    skipped = ["p2", "final", "R01", "c", "2", "n", "s", "single_rule", "x", "t", "f", "a", " NO ", ""]
    path = write(tmp_path / "p.csv", ["﻿" + header, ",".join(cells), ",".join(skipped)])
    with pytest.raises(Exception, match="(?i)malformed"):
        rd.read_attack_prompts(spark, path).collect()
    got = rd.read_attack_prompts(spark, path, multi_line=True).collect()
    assert [r.prompt_id for r in got] == ["p1"] and got[0].level == 1
    assert got[0].prompt_text == '한국어, "인용" 줄\n둘' and got[0].notes == ""
    with pytest.raises(ValueError, match="missing required columns"):
        rd.read_text_table(spark, path, ["nope"])


def test_scenarios_are_filtered_and_split(spark, tmp_path):
    def line(**kw):
        return ",".join(f'"{kw.get(c, "")}"' for c in sc.SCENARIO_COLUMNS)

    path = write(tmp_path / "s.csv", [",".join(sc.SCENARIO_COLUMNS), line(scenario_id="a", use_for_frontier_q2="Yes", system_rule_set="R01, R02,"), line(scenario_id="b", use_for_frontier_q2="no"), line(scenario_id="c", use_for_frontier_q2="yes", is_valid_prompt="no")])
    got = rd.read_scenarios(spark, path).collect()
    assert [(r.scenario_id, r.rule_ids) for r in got] == [("a", ["R01", "R02"])]


def test_other_readers(spark, tmp_path):
    export = write(tmp_path / "chat.json", [json.dumps([{"id": "1", "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}])])
    assert rd.read_chat_export(spark, export).select(F.explode("conversations")).count() == 2
    bench = write(tmp_path / "b.jsonl", [{"AXIS": "x", "CONVERSATION": [{"role": "user", "content": "q"}], "TARGET_QUESTION": "t", "PASS_CRITERIA": "YES", "QUESTION_ID": "id1"}])
    assert rd.read_benchmark_conversations(spark, bench).collect()[0].source_id == "id1"
    prompts = write(tmp_path / "i.jsonl", [{"prompt": "p", "instruction_id_list": ["a:b"]}, {"prompt": "", "instruction_id_list": ["a:b"]}, {"prompt": "q", "instruction_id_list": []}])
    assert rd.read_instruction_prompts(spark, prompts).count() == 1
    for name in ("basic/Lock_2.jsonl", "basic/Lock_1.jsonl", "redteam/Lock.jsonl", "basic/Other.jsonl"):
        write(tmp_path / name, [{"params": {"k": name}, "messages": [{"role": "user", "content": name}]}])
    suites = rd.read_suites(spark, str(tmp_path), ["basic", "redteam"], ["Lock"])
    assert [(r.suite, r.scenario, r.params["k"]) for r in suites.orderBy("ingest_ord").collect()] == [
        ("basic", "Lock", "basic/Lock_1.jsonl"), ("basic", "Lock", "basic/Lock_2.jsonl"), ("redteam", "Lock", "redteam/Lock.jsonl")
    ]
    assert rd.read_or_empty(spark, f"{tmp_path}/missing.jsonl", "a int").count() == 0
    key = {"case_id": "a", "rep": 0, "model": "m", "temperature": 0.0, "turn": 1, "score_index": 0, "rule_id": "R1"}
    side = write(tmp_path / "side.jsonl", [{"timestamp": "2026-01-01T00:00:00+00:00", "key": key, "score": {"rule_id": "R1", "pass": True, "detail": "d"}}])
    row = rd.read_judge_checkpoints(spark, side).collect()[0]
    assert row["pass"] is True and row.case_id == "a" and row.timestamp is not None


def test_csv_sink_keeps_order_and_blanks_nulls(spark, tmp_path):
    df = spark.createDataFrame([(2, None, 'q"x,'), (1, 0.5, "")], "b int, a double, c string")
    wr.write_table_csv(df, f"{tmp_path}/out", ["c", "b", "a"], ["b"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines()[0] == "c,b,a"
    assert text.splitlines()[1:] == [",1,0.5", '"q""x,",2,']


def test_versions_switch_only_when_complete(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert wr.read_current(spark, path) is None
    assert wr.write_version(spark.range(2), path) == 1
    current = wr.read_current(spark, path)
    assert wr.write_version(current.withColumn("id", F.col("id") + 10), path) == 2
    assert sorted(r.id for r in wr.read_current(spark, path).collect()) == [10, 11]
    (tmp_path / "t" / "version=3").mkdir()
    assert wr.versions(spark, path) == [1, 2]


def test_enriched_variant_and_summary_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "m", 0.0, "v1"), ("b", "m", 0.7, "v2")], "case_id string, model string, temperature double, variant string")
    wr.write_enriched(rows, f"{tmp_path}/e")
    wr.write_json_lines(rows, f"{tmp_path}/j")
    wr.write_variants(rows, f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/e").filter("temperature = 0.7").count() == 1
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    assert sorted(p.name for p in (tmp_path / "v").glob("variant=*")) == ["variant=v1", "variant=v2"]
    wr.write_summary(spark, f"{tmp_path}/s", rows.agg(F.count("*").alias("records")), {"definition": "x"})
    assert spark.read.json(f"{tmp_path}/s").collect()[0].asDict() == {"records": 2, "definition": "x"}


TRICKY = ['plain', 'a } b', '{', '}}}', 'quote " and }', 'back\\slash', 'ends with \\', '\\"}', 'two\nlines', '[1, {', '한글 } 😊', '', '\\\\" }']


def chats(n):
    return [
        {"id": f"c{i}", "conversations": [{"from": "human", "value": TRICKY[(i + k) % len(TRICKY)] * (1 + k)} for k in range(i % 5)]}
        for i in range(n)
    ]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [37, 4096, 10**9])
def test_one_json_array_is_read_by_many_tasks(spark, tmp_path, indent, size):
    rows = chats(200)
    (tmp_path / "chat.json").write_text("﻿" * (size == 4096) + json.dumps(rows, indent=indent, ensure_ascii=bool(indent)) + "\n", encoding="utf-8")
    (tmp_path / "none.json").write_text("[]", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        paths = [f"{tmp_path}/chat.json", f"{tmp_path}/none.json"]
        got = ja.read_json_array(spark, paths, sc.CHAT_EXPORT).orderBy("element").collect()
        splits = spark.read.option("lineSep", "}").text(paths[:1]).select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.element for r in got] == list(range(200)) and all(r._corrupt_record is None for r in got)
    assert [{"id": r.id, "conversations": [t.asDict(True) for t in r.conversations]} for r in got] == rows
    assert splits > 1


def test_split_array_equals_the_whole_file_reader(spark, tmp_path):
    path = write(tmp_path / "chat.json", [json.dumps(chats(50))])
    split = ja.read_json_array(spark, path, sc.CHAT_EXPORT).select("id", "conversations")
    assert sorted(map(str, split.collect())) == sorted(map(str, rd.read_chat_export(spark, path).collect()))


def test_broken_elements_are_kept(spark, tmp_path):
    path = write(tmp_path / "chat.json", ['[{"id": "a", "conversations": []}, {"id": b}, {"id": "c"}, {"id": "cut off", "conv'])
    got = {r.element: (r.id, r._corrupt_record) for r in ja.read_json_array(spark, path, sc.CHAT_EXPORT).collect()}
    assert got[0] == ("a", None) and got[2] == ("c", None)
    assert got[1][1] == '{"id": b}' and got[3][1].startswith('{"id": "cut off"')
