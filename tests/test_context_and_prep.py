import random
import re

import pytest
from pyspark.sql import functions as F

from holdfast.operators import context as cx
from holdfast.operators import prep


def ten_turns(spark):
    data = [(1, i, "user" if i % 2 == 0 else "assistant", f"message number {i} with some words") for i in range(10)]
    return spark.createDataFrame(data, "case_id int, turn int, role string, content string").withColumn(
        "system_prompt", F.lit("Be kind.\n\n  Keep SECRET123 safe.  ")
    )


def test_window_keeps_the_last_turns(spark):
    kept = cx.keep_last(ten_turns(spark), 3)
    assert sorted(r.turn for r in kept.collect()) == [7, 8, 9]
    assert cx.keep_last(ten_turns(spark), 10).count() == 10


def test_window_on_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([1],), ([],)], "a array<int>")
    assert [r.x for r in df.select(cx.keep_last_nested("a", 3).alias("x")).collect()] == [[2, 3, 4], [1], []]


def test_sizes_and_ratio(spark):
    turns = ten_turns(spark)
    out = cx.apply_variants(turns, [("sliding_window", {"window_size": 3}), ("sliding_window", {"window_size": 10})])
    got = {r.variant: r for r in cx.size_change(turns, out).collect()}
    assert got["sliding_window_3"].compression_ratio == 0.3 and got["sliding_window_3"].original_token_count == 60
    assert got["sliding_window_10"].compression_ratio == 1.0


def test_empty_content_has_ratio_one(spark):
    turns = ten_turns(spark).withColumn("content", F.lit(""))
    row = cx.size_change(turns, cx.apply_variant(turns, "selective_context", target_ratio=0.5)).collect()[0]
    assert (row.original_token_count, row.compressed_token_count, row.compression_ratio) == (0, 0, 1.0)


def test_reminder_after_every_third_user_turn(spark):
    out = cx.reinforce(ten_turns(spark), 3).orderBy("turn", "slot").collect()
    assert len(out) == 11
    extra = [r for r in out if r.slot == 1]
    assert [(r.turn, r.role) for r in extra] == [(4, "assistant")]
    assert extra[0].content == "[REMINDER] I must follow these rules:\n- Be kind.\n- Keep SECRET123 safe."


def test_reminder_is_cut_by_words(spark):
    text = spark.range(1).select(cx.reminder_text(F.lit("a b c d"), 8).alias("x")).collect()[0].x
    assert text == "[REMINDER] I must follow these rules: - a"


def brute_prune(text, ratio):
    import re

    words = text.split()
    if len(words) <= 2:
        return text
    scored = []
    for i, w in enumerate(words):
        tokens = len(re.findall(r"[^\W]+|[^\w\s]", w))
        scored.append((tokens + len(w.strip(".,!?;:\"'()[]{}")) / 10.0, i))
    drop = {i for _, i in sorted(scored)[: len(words) - max(1, int(len(words) * ratio))]}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


@pytest.mark.parametrize("ratio", [0.0, 0.3, 0.5, 0.75, 1.0])
def test_pruning_equals_brute_force(spark, ratio):
    texts = ["a b", "the quick (brown) fox, jumps over the lazy dog.", "a a a a", "é à ü (x) y!", " lead and trail ", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", cx.prune_words("t", ratio).alias("p")).collect():
        assert row.p == brute_prune(row.t, ratio)


def test_summaries_fall_back_to_the_original(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "w " * 60), (1, 1, "assistant", "short"), (1, 2, "user", "v " * 60)],
        "case_id int, turn int, role string, content string",
    )
    summaries = spark.createDataFrame([(1, 0, "sum"), (1, 1, "never")], "case_id int, turn int, summary string")
    got = {r.turn: r.content for r in cx.apply_summaries(turns, summaries, 50).collect()}
    assert got[0] == "sum" and got[1] == "short" and got[2] == "v " * 60


def test_registered_transform_and_variant_names(spark):
    cx.register_transform("drop_all", lambda turns: turns.filter(F.lit(False)))
    assert cx.apply_variant(ten_turns(spark), "drop_all").count() == 0
    assert cx.variant_name("selective_context", {"target_ratio": 0.5}) == "selective_context_050"
    assert cx.variant_name("system_prompt_reinforce", {"injection_interval": 3}) == "reinforce_3"


def test_history_rendering(spark):
    df = spark.createDataFrame([(["a", "b", "c"], "reinforced"), (["a"], "once"), ([], "once")], "t array<string>, s string")
    got = [r.x for r in df.select(cx.embed_history(cx.user_history("t", "s"), F.lit("Q?")).alias("x")).collect()]
    assert got[0].count("[시스템 알림") == 1 and got[0].index("User: b") < got[0].index("[시스템") < got[0].index("User: c")
    assert got[0].endswith("다음 질문에 답하세요:\nQ?") and "[시스템" not in got[1] and got[2] == "Q?"


def test_user_turns_and_bins(spark):
    data = [(1, "human", " hello there my good friend "), (2, "gpt", "no"), (3, "user", " \t"), (4, "user", "one two three four five six")]
    df = spark.createDataFrame(data, "ord int, role string, text string")
    turns = prep.user_turns(df)
    assert sorted(r.ord for r in turns.collect()) == [1, 4]
    binned = prep.bin_turns(turns, {"a": (1, 5), "b": (6, 9)}, 1, [F.col("ord")]).collect()
    assert sorted((r.turn_id, r.token_count) for r in binned) == [("pool_a_0", 5), ("pool_b_0", 6)]
    with pytest.raises(ValueError, match="overlap"):
        prep.token_bin("x", {"a": (1, 5), "b": (5, 9)})


def test_prep_counters(spark):
    df = spark.createDataFrame([("hello there friend", True), ("xx", False), ("another english text", True)], "content string, keep boolean")
    row = prep.prep_counters(df, {"a": (1, 9)}, 1).collect()[0]
    assert (row.extracted, row.filtered, row.kept_a) == (3, 1, 1)


def test_task_rule_split(spark):
    cases = [
        ("Write a poem. Your response should contain no commas.", "Write a poem.", "Your response should contain no commas."),
        ("Who? Make sure it rhymes.", "Who?", "Make sure it rhymes."),
        ("Tell me.\nMore text do not use commas", "Tell me.", "More text do not use commas"),
        ("Plain task", "Plain task", ""),
        ("ENSURE this", "", "ENSURE this"),
    ]
    for prompt, task, rules in cases:
        got = spark.range(1).select(prep.split_task_and_rules(F.lit(prompt)).alias("s")).collect()[0].s
        assert (got["task"], got["rules"]) == (task, rules), prompt


def test_instruction_probes_keep_scorable_prompts_only(spark):
    data = [("Do it. Ensure caps.", ["punctuation:no_comma"]), ("Do.", ["punctuation:no_comma", "odd:x"]), ("", ["punctuation:no_comma"]), ("Go", [])]
    df = spark.createDataFrame(data, "prompt string, instruction_ids array<string>")
    got = prep.instruction_probes(df, ["punctuation:no_comma"]).collect()
    assert [r.prompt for r in got] == ["Do it. Ensure caps."]
    assert got[0].system_prompt.endswith(":\nEnsure caps.") and got[0].rule_count == 1


def test_scenario_probe_takes_the_last_user_message(spark):
    cases = spark.createDataFrame(
        [("s", "basic", 1, {"k": "v"}, [("user", "first"), ("assistant", "x"), ("user", "last")]), ("s", "basic", 2, {}, [("assistant", "x")])],
        "scenario string, suite string, ord int, params map<string,string>, messages array<struct<role:string,content:string>>",
    )
    scenarios = spark.createDataFrame([("s", "key {k}", None, 3)], "scenario string, template string, check_template string, rule_count int")
    got = prep.scenario_probes(cases, scenarios, 5, [F.col("ord")]).collect()
    assert len(got) == 1 and got[0].probe == "last" and got[0].system_prompt == "key v"
    assert got[0].scoring_check == "manual check required" and got[0].probe_id == "rules_s_basic_0"


def test_nested_turns(spark):
    df = spark.createDataFrame([([("user", "a"), ("system", "b"), ("assistant", "")],)], "c array<struct<role:string,content:string>>")
    assert [m["content"] for m in df.select(prep.nested_turns("c").alias("x")).collect()[0].x] == ["a"]


def plain_tokens(text):
    return len(re.findall(r"\w+|[^\w\s]", text))


@pytest.mark.parametrize("separator", [" ", "", "\n", "-", " x ", "ab"])
@pytest.mark.parametrize("block", [1, 3, 4096])
def test_tokens_of_joined_text_without_joining(spark, separator, block):
    draw = random.Random(5)
    pieces = ["", "", "a", "ab cd", " ", "...", "x-", "-y", " z", "가나", "1", "\n", "end."]
    cases = {f"c{i}": [draw.choice(pieces) for _ in range(draw.choice([1, 2, 3, 7, 20]))] for i in range(60)}
    cases |= {"empty": ["", "", ""], "run": ["ab"] * 30, "one": [""], "gap": ["", "", "x", "", "", "y", ""]}
    rows = [(c, 2 * t - 5, s) for c, texts in cases.items() for t, s in enumerate(texts)] + [("run", 1000, None)]
    df = spark.createDataFrame(rows, "case_id string, turn int, content string").repartition(5)
    got = {r.case_id: r.tokens for r in cx.joined_token_count(df, ["case_id"], ["turn"], separator=separator, block=block).collect()}
    assert got == {c: plain_tokens(separator.join(texts)) for c, texts in cases.items()}


def test_joined_tokens_keep_texts_where_they_are(spark):
    df = spark.createDataFrame([("a", 1, "long text " * 50)], "case_id string, turn int, content string")
    plan = cx.joined_token_count(df, ["case_id"], ["turn"])._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Window" in plan
    for line in plan.splitlines():
        if "Exchange" in line or "Window" in line:
            assert "content" not in line
