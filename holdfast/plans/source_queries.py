"""Readers and sinks over files that Spark writes from the given tables, and user extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast import schemas as sc
from holdfast.functions import counters as ct
from holdfast.operators import custom_metrics as cm
from holdfast.operators import rescoring as rs
from holdfast.operators.common import rounded
from holdfast.plans import testbed as tb
from holdfast.plans.registry import query
from holdfast.plans.text_queries import TOKENS, count_sql
from holdfast.sources import json_array as ja
from holdfast.sources import readers as rd
from holdfast.sources import writers as wr
from holdfast.streaming.jobs import work_folder

# --- JSON lines ------------------------------------------------------------------------------


def _record_lines(spark, sf):
    """A JSON line per order; every 50th is cut off, every 49th followed by a blank line."""
    key = F.col("o_orderkey")
    turn = F.struct(F.lit(1).alias("turn"), F.concat(F.lit("order of "), F.col("o_custkey").cast("string")).alias("response"))
    record = F.to_json(
        F.struct(
            key.cast("string").alias("case_id"), (key % 3).cast("int").alias("rep"), F.col("o_orderpriority").alias("model"),
            F.when(key % 4 == 0, F.lit(0.7)).alias("temperature"),
            F.when(key % 4 == 1, F.struct(F.lit(0.2).alias("temperature"))).alias("generation_config"),
            F.array(turn).alias("turn_results"),
        )
    )
    line = F.when(key % 50 == 0, F.left(record, F.lit(20))).otherwise(record)
    return tb.table(spark, sf, "orders").select(F.when(key % 49 == 0, F.concat(line, F.lit("\n  "))).otherwise(line).alias("value"), key)


@query(
    "run_record_lines",
    """SELECT CAST(o_orderkey AS VARCHAR) AS case_id, CAST(o_orderkey % 3 AS INTEGER) AS rep, o_orderpriority AS model,
      CASE o_orderkey % 4 WHEN 0 THEN 0.7 WHEN 1 THEN 0.2 ELSE 0.0 END::DOUBLE AS temperature, 'order of ' || o_custkey AS response
    FROM orders WHERE o_orderkey % 50 <> 0""",
)
def run_record_lines(spark, sf):
    """Two folders of result lines: the preferred name where there is one, unreadable lines left out."""
    folder = work_folder(spark, "lines")
    lines = _record_lines(spark, sf)
    lines.select("value").write.text(f"{folder}/fast_results_a")
    lines.limit(0).select("value").write.text(f"{folder}/results_a")
    paths = rd.preferred_paths(spark, f"{folder}/fast_results_*", f"{folder}/results_*")
    rows = rd.read_run_records(spark, paths)
    return rows.select("case_id", "rep", "model", "temperature", F.col("turn_results")[0]["response"].alias("response"))


@query(
    "quarantined_lines",
    """SELECT left('{"case_id":"' || o_orderkey || '","rep":' || (o_orderkey % 3) || ',"model":"' || o_orderpriority, 20) AS start,
      count(*) AS lines FROM orders WHERE o_orderkey % 50 = 0 GROUP BY 1""",
)
def quarantined_lines(spark, sf):
    folder = work_folder(spark, "lines")
    _record_lines(spark, sf).select("value").write.text(f"{folder}/lines")
    rows = rd.read_json_lines(spark, f"{folder}/lines", sc.RUN_RECORD)
    wr.write_with_summary(rows, f"{folder}/records", f"{folder}/summary", {})
    broken = rd.quarantined(spark.read.parquet(f"{folder}/records"))
    return broken.groupBy(F.col(rd.CORRUPT).alias("start")).agg(F.count(F.lit(1)).alias("lines"))


@query(
    "result_tree_scan",
    """SELECT 'model=m' || (o_orderkey % 3) AS model_name, 'variant=' || lower(o_orderstatus) AS variant_name, count(*) AS records,
      sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1, 2""",
)
def result_tree_scan(spark, sf):
    """Model and variant from the folders of a result tree."""
    folder = work_folder(spark, "tree")
    key = F.col("o_orderkey")
    rows = tb.table(spark, sf, "orders").select(
        key.alias("case_id"), F.concat(F.lit("m"), (key % 3).cast("string")).alias("model"), F.lower("o_orderstatus").alias("variant")
    )
    rows.write.partitionBy("model", "variant").json(folder)
    read = rd.read_result_tree(spark, folder, "case_id long", "*.json")
    return read.groupBy("model_name", "variant_name").agg(F.count(F.lit(1)).alias("records"), F.sum("case_id").alias("keys"))


# --- one large JSON array ------------------------------------------------------------------------


def write_chat_export(rows, path: str, files: int = 8) -> None:
    """JSON arrays of conversations, one per file: brackets and elements as ordered lines."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(files)).cast("int"))
    body = F.to_json(F.struct("id", "conversations"))
    lines = rows.select("bucket", F.lit(1).alias("part"), F.concat(F.lit(","), body).alias("line"))
    # The first element is an empty one, so that every other line may start with a comma.
    brackets = rows.select("bucket").distinct().select(
        "bucket", F.inline(F.array(F.struct(F.lit(0).alias("part"), F.lit('[{"id": null}').alias("line")),
                                   F.struct(F.lit(2).alias("part"), F.lit("]").alias("line"))))
    )
    ordered = lines.unionByName(brackets).repartition(files, "bucket").sortWithinPartitions("bucket", "part")
    ordered.select("bucket", F.col("line").alias("value")).write.partitionBy("bucket").text(path)


@query(
    "chat_export_turns",
    """SELECT CAST(conv_id AS VARCHAR) AS id, count(*) AS turns, md5(string_agg(coalesce(role, '') || ':' || coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS said
    FROM conversations GROUP BY 1""",
)
def chat_export_turns(spark, sf):
    """All conversations through JSON arrays whose files are read in pieces."""
    folder = work_folder(spark, "chat")
    turns = tb.table(spark, sf, "conversations")
    line = F.struct("turn", F.coalesce("role", F.lit("")).alias("from"), F.coalesce("text", F.lit("")).alias("value"))
    rows = turns.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("conversations"))
    write_chat_export(rows, folder)
    read = ja.read_json_array(spark, folder, sc.CHAT_EXPORT).filter(F.col("id").isNotNull())
    said = F.array_join(F.transform("conversations", lambda t: F.concat(t["from"], F.lit(":"), t["value"])), "\n")
    return read.select("id", F.size("conversations").cast("long").alias("turns"), F.md5(said.cast("binary")).alias("said"))


# --- tables and sinks ------------------------------------------------------------------------------


@query(
    "text_table_roundtrip",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(c_name, '') AS c_name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment,
      'say "' || c_name || '", again' AS quoted FROM customer""",
)
def text_table_roundtrip(spark, sf):
    """A CSV sink read back as text: fixed columns, nulls as empty cells, quotes kept."""
    path = f"{work_folder(spark, 'csv')}/table"
    rows = tb.table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("c_mktsegment"),
        F.concat(F.lit('say "'), "c_name", F.lit('", again')).alias("quoted"),
    )
    wr.write_table_csv(rows, path, ["quoted", "c_mktsegment", "c_custkey", "c_name"])
    return rd.read_text_table(spark, path, ["c_custkey", "quoted"])


@query(
    "versioned_rewrite",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS status, 2 AS versions FROM orders",
)
def versioned_rewrite(spark, sf):
    """A table rewritten from itself; readers see the newest complete version."""
    path = f"{work_folder(spark, 'table')}/orders"
    wr.write_version(tb.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), path)
    current = wr.read_current(spark, path)
    wr.write_version(current.withColumn("status", F.when(F.col("status") == "F", F.lit("done")).otherwise(F.col("status"))), path)
    return wr.read_current(spark, path).withColumn("versions", F.lit(len(wr.versions(spark, path))))


@query(
    "run_summary_counters",
    """SELECT count(*) AS lines, count(*) FILTER (o_orderkey % 50 = 0) AS quarantined_lines, count(*) FILTER (o_orderkey % 50 <> 0 AND o_orderkey % 4 = 0) AS warm,
      'share of rules passed' AS definition, count(*) FILTER (o_orderkey % 50 <> 0) AS rows_kept FROM orders""",
)
def run_summary_counters(spark, sf):
    """Counters collected while the records are written, beside the unreadable lines."""
    folder = work_folder(spark, "summary")
    _record_lines(spark, sf).select("value").write.text(f"{folder}/lines")
    rows = rd.read_json_lines(spark, f"{folder}/lines", sc.RUN_RECORD)
    wr.write_with_summary(
        rows, f"{folder}/records", f"{folder}/summary", {"definition": "share of rules passed"},
        {"warm": F.count_if(F.col("temperature") > 0)},
    )
    summary = spark.read.schema("lines long, quarantined_lines long, warm long, definition string").json(f"{folder}/summary")
    kept = spark.read.parquet(f"{folder}/records").filter(~F.col("quarantined")).count()
    return summary.withColumn("rows_kept", F.lit(kept).cast("long"))


# --- re-scoring by differences --------------------------------------------------------------------

AUDIT_SQL = f"""{tb.CELLS_SQL},
audited AS (SELECT * REPLACE (CASE WHEN l_partkey % 13 <> 0 THEN pass WHEN l_partkey % 2 = 0 THEN NULL ELSE NOT pass END AS pass),
    l_partkey % 13 = 0 AND pass IS NOT NULL AS touched FROM cells)
"""


@query(
    "rescored_turns",
    f"""WITH {AUDIT_SQL}
    SELECT case_id, turn, round(coalesce(avg(CASE WHEN pass THEN 1.0 WHEN NOT pass THEN 0.0 END), 1.0), 6) AS per_rule_pass_rate,
      CASE WHEN coalesce(bool_and(pass), TRUE) THEN 1.0 ELSE 0.0 END::DOUBLE AS perfect_success,
      CASE WHEN len(any_value(attack_targets)) > 0 THEN bool_and(pass) FILTER (list_contains(attack_targets, rule_id)) END::INT::DOUBLE AS targeted_rule_success,
      CASE WHEN len(any_value(attack_targets)) > 0 THEN bool_or(NOT pass) FILTER (NOT list_contains(attack_targets, rule_id)) END::INT::DOUBLE AS non_target_failure,
      count(*) FILTER (touched) AS changed_cells
    FROM audited GROUP BY case_id, turn""",
)
def rescored_turns(spark, sf):
    """Metrics after an audit, from stored counts and signed changes; equal to scoring all cells anew."""
    cells, keys = tb.score_cells(spark, sf), ["case_id", "turn"]
    part = F.col("score_index")
    audited = F.when(part % 2 == 0, F.lit(None).cast("boolean")).otherwise(~F.col("pass"))
    changed = cells.filter((part % 13 == 0) & F.col("pass").isNotNull()).withColumn("pass_before", F.col("pass"))
    changes = rs.change_counts(changed.withColumn("pass", audited), keys)
    return rounded(rs.metrics_of_counts(rs.merged_counts(rs.metric_counts(cells, keys), changes, keys)))


# --- extensions ------------------------------------------------------------------------------------

ct.register_counter("python_pattern", ct.pattern_counter(r"\w+|[^\w\s]"))


@query("conversation_tokens_python", rf"SELECT conv_id, turn, {count_sql('text', TOKENS)} AS tokens FROM conversations")
def conversation_tokens_python(spark, sf):
    """The token counts of the default counter by a counter written in Python."""
    counter = ct.counter_named("python_pattern")
    return tb.table(spark, sf, "conversations").select("conv_id", "turn", counter("text").alias("tokens"))


cm.register_metric(
    "failure_skew",
    cm.NativeMetric(
        start={"n": "count(pass)", "bad": "count_if(NOT pass)", "worst": "max(score_index)"},
        merge={"n": "sum(n)", "bad": "sum(bad)", "worst": "max(worst)"},
        finish="round(try_divide(CAST(bad AS DOUBLE) * 100, n) + CAST(worst AS DOUBLE) / 1000000, 6)",
    ),
)


@query(
    "custom_metric_native",
    f"""WITH {tb.CELLS_SQL} SELECT rule_id, model, round(count(*) FILTER (NOT pass) * 100.0 / nullif(count(pass), 0) + max(score_index) / 1e6, 6) AS failure_skew
    FROM cells GROUP BY 1, 2""",
)
def custom_metric_native(spark, sf):
    return cm.grouped_metric(tb.score_cells(spark, sf), ["rule_id", "model"], "failure_skew")


def _moments(frame):
    x = frame["o_totalprice"].dropna()
    return {"n": len(x), "total": float(x.sum()), "most": float(x.max()) if len(x) else None}


def _merged_moments(frame):
    return {"n": int(frame["n"].sum()), "total": float(frame["total"].sum()), "most": frame["most"].max()}


cm.register_metric(
    "peak_to_mean",
    cm.ArrowMetric(
        ["o_totalprice"], "n long, total double, most double", _moments, _merged_moments,
        "round(try_divide(most, try_divide(total, n)), 6)",
    ),
)


@query(
    "custom_metric_python",
    "SELECT o_orderpriority, CAST(o_custkey % 3 AS INTEGER) AS kind, round(max(o_totalprice) / avg(o_totalprice), 6) AS peak_to_mean FROM orders GROUP BY 1, 2",
)
def custom_metric_python(spark, sf):
    rows = tb.table(spark, sf, "orders").withColumn("kind", (F.col("o_custkey") % 3).cast("int"))
    return cm.grouped_metric(rows, ["o_orderpriority", "kind"], "peak_to_mean")
