import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast import schemas as sc
from holdfast.functions import counters as ct
from holdfast.functions import rules as rl
from holdfast.operators import cells as ce
from holdfast.operators import context as cx
from holdfast.operators import custom_metrics as cm
from holdfast.operators import rescoring as rs
from holdfast.sources import readers as rd
from holdfast.sources import writers as wr


def test_python_counter_in_an_operator(spark):
    df = spark.createDataFrame([(1, 1, "ab, cd"), (1, 2, None), (2, 1, "")], "case_id int, turn int, content string")
    counter = ct.pattern_counter(r"\w+|[^\w\s]")
    got = df.select(counter("content").alias("n")).collect()
    assert [r.n for r in got] == [3, None, 0]
    rows = cx.joined_token_count(df, ["case_id"], ["turn"], counter=counter).collect()
    assert {r.case_id: r.tokens for r in rows} == {1: 3, 2: 0}
    ct.register_counter("mine", counter)
    assert ct.counter_named("mine") is counter


def cells(spark, n=400, seed=1):
    draw = random.Random(seed)
    data = [
        (f"c{i % 23}", i % 4, draw.choice(["R1", "R2"]), draw.choice([True, False, None]), draw.choice([["R1"], [], ["R2", "R1"]]))
        for i in range(n)
    ]
    data = [(c, t, r, p, ["R1"] if int(c[1:]) % 2 else []) for c, t, r, p, _ in data]
    return ce.with_target_flags(spark.createDataFrame(data, "case_id string, turn int, rule_id string, pass boolean, attack_targets array<string>"))


def metrics(rows):
    return {(r.case_id, r.turn): (round(r.per_rule_pass_rate, 9), r.perfect_success, r.targeted_rule_success, r.non_target_failure) for r in rows.collect()}


def test_metrics_by_differences_equal_a_full_count(spark):
    keys = ["case_id", "turn"]
    before = cells(spark).withColumn("id", F.monotonically_increasing_id()).cache()
    assert metrics(rs.metrics_of_counts(rs.metric_counts(before, keys))) == metrics(ce.turn_metrics(before, keys))
    new = F.when(F.col("id") % 3 == 0, F.lit(None).cast("boolean")).otherwise(F.coalesce(~F.col("pass"), F.lit(True)))
    touched = F.col("id") % 7 == 0
    changes = before.filter(touched).withColumn("pass_before", F.col("pass")).withColumn("pass", new)
    stored = rs.metric_counts(before, keys)
    merged = rs.merged_counts(stored, rs.change_counts(changes, keys), keys)
    after = before.withColumn("pass", F.when(touched, new).otherwise(F.col("pass")))
    assert metrics(rs.metrics_of_counts(merged)) == metrics(ce.turn_metrics(after, keys))
    assert merged.agg(F.sum("changed_cells")).first()[0] == before.filter(touched).count()
    none = rs.merged_counts(stored, rs.change_counts(changes.limit(0), keys), keys)
    assert none.drop("changed_cells").exceptAll(stored.select(none.drop("changed_cells").columns)).count() == 0


def test_native_metric_is_two_aggregates_on_salted_groups(spark):
    cm.register_metric("spread", cm.NativeMetric(
        {"lo": "min(x)", "hi": "max(x)", "n": "count(x)"}, {"lo": "min(lo)", "hi": "max(hi)", "n": "sum(n)"}, "CASE WHEN n > 1 THEN hi - lo END"))
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN 'hot' WHEN id = 0 THEN NULL ELSE concat('k', id % 9) END AS key", "id AS x")
    rows = cm.grouped_metric(df, ["key"], "spread")
    want = {r.key: (r.b - r.a if r.n > 1 else None) for r in df.groupBy("key").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("x").alias("n")).collect()}
    assert {r.key: r.spread for r in rows.collect()} == want
    assert "_salt" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_python_metric_sees_batches_only(spark):
    def start(frame: pd.DataFrame):
        assert len(frame) <= 50
        return {"words": sorted(set(frame["w"].dropna()))}

    def merge(frame: pd.DataFrame):
        return {"words": sorted({w for ws in frame["words"] for w in ws})}

    cm.register_metric("kinds", cm.ArrowMetric(["w"], "words array<string>", start, merge, "size(words)"))
    df = spark.range(1000).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 5 = 0 THEN NULL ELSE 'other' END AS key", "CASE WHEN id % 11 > 0 THEN concat('w', id % 13) END AS w")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.key: r.kinds for r in cm.grouped_metric(df.repartition(7), ["key"], "kinds").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {r.key: r.n for r in df.groupBy("key").agg(F.count_distinct("w").alias("n")).collect()}
    assert got == want


def test_summary_is_collected_while_writing(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"case_id": "a"}\n{broken\n\n{"case_id": "b"}\n')
    rows = rd.read_json_lines(spark, f"{tmp_path}/in.jsonl", sc.RUN_RECORD)
    seen = wr.write_with_summary(rows, f"{tmp_path}/out", f"{tmp_path}/sum", {"definition": "d"}, {"cases": F.count("case_id")})
    assert seen == {"lines": 3, "quarantined_lines": 1, "cases": 2}
    summary = spark.read.json(f"{tmp_path}/sum").first().asDict()
    assert summary == {**seen, "definition": "d"}
    out = spark.read.parquet(f"{tmp_path}/out")
    assert [r[0] for r in out.filter("quarantined = 'true'").select(rd.CORRUPT).collect()] == ["{broken"]
    assert sorted(r.case_id for r in out.filter("quarantined = 'false'").collect()) == ["a", "b"]


def test_counting_adds_no_scan(spark, tmp_path):
    plans = []

    def write(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        df.write.parquet(f"{tmp_path}/out")

    spark.range(100).write.parquet(f"{tmp_path}/in")
    source = spark.read.parquet(f"{tmp_path}/in")
    seen = wr.write_counted(source, {"n": F.count(F.lit(1)), "top": F.max("id")}, write, lambda df: df.filter("id % 2 = 0"))
    assert seen == {"n": 100, "top": 99} and spark.read.parquet(f"{tmp_path}/out").count() == 50
    assert plans[0].count("FileScan") == 1 and "CollectMetrics" in plans[0]


@pytest.mark.parametrize("known", [True, False])
def test_patterns_from_a_table(spark, known):
    full = f"array<{rl.RULE_TYPE}>"
    texts = ["abc", "a\nb", "", "x1", None]
    patterns = ["^a", "b$", "", r"\d", "^a$", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, response string")
    rules = [{"rule_id": f"R{k}", "scoring": "regex", "pattern": p, "negate": k % 2 == 0} for k, p in enumerate(patterns)]
    df = df.withColumn("rules", rl.rules_literal(rules).cast(full))
    listed = rl.patterns_in(df)
    assert listed == sorted(p for p in patterns if p is not None)
    assert rl.patterns_in(df, limit=2) == []
    got = {(r.id, r.rule_id): (r["pass"], r.detail) for r in rl.score_cells(df, patterns=listed if known else ()).collect()}
    static = {(r.id, r.rule_id): (r["pass"], r.detail) for r in rl.score_cells_static(df.drop("rules"), rules).collect()}
    assert got == static
