"""Streaming jobs run over the given tables until all present data is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.plans import testbed as tb
from holdfast.plans.registry import query
from holdfast.streaming import jobs


def _stream(spark, sf, name):
    """A file stream over one given table (its single file, or its folder of files)."""
    schema = tb.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


def event_stream(spark, sf):
    """Events with a zone-free time read as UTC."""
    rows = _stream(spark, sf, "events")
    as_utc = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    return rows.withColumn("ts", as_utc)


@query("streamed_score_cells", f"WITH {tb.RESPONSES_SQL} SELECT case_id, turn, rule_id, pass, method FROM text_cells")
def streamed_score_cells(spark, sf):
    raw = _stream(spark, sf, "conversations")
    cells = jobs.score_stream(tb.responses_from(raw), tb.TEXT_RULES, active=tb.rule_is_active)
    folder = jobs.work_folder(spark, "cells")
    jobs.run_available(
        cells.select("case_id", "turn", "rule_id", "pass", "method"), f"{folder}/out", f"{folder}/log"
    )
    return spark.read.parquet(f"{folder}/out")


@query("streamed_dedupe", "SELECT event_id, event_type FROM events")
def streamed_dedupe(spark, sf):
    """Every event is sent twice; each id comes out once."""
    sent = event_stream(spark, sf).select(
        "event_type", "ts", F.explode(F.array("event_id", "event_id")).alias("event_id")
    )
    folder = jobs.work_folder(spark, "dedupe")
    jobs.run_available(
        jobs.deduplicated(sent, ["event_id"], "ts", "2 days").select("event_id", "event_type"),
        f"{folder}/out", f"{folder}/log",
    )
    return spark.read.parquet(f"{folder}/out")


@query(
    "streamed_verdict_merge",
    """SELECT user_id AS slot, max(event_id) AS ord, arg_max(event_type, event_id) AS verdict FROM events GROUP BY 1""",
)
def streamed_verdict_merge(spark, sf):
    verdicts = event_stream(spark, sf).select(
        F.col("user_id").alias("slot"), F.col("event_id").alias("ord"), F.col("event_type").alias("verdict")
    )
    folder = jobs.work_folder(spark, "verdicts")
    jobs.run_available(
        verdicts, f"{folder}/out", f"{folder}/log",
        write=jobs.verdict_log_writer(f"{folder}/out", ["slot"], "ord"),
    )
    return jobs.current_verdicts(spark, f"{folder}/out", ["slot"], "ord").select("slot", "ord", "verdict")


CELLS_SQL = """cells AS (SELECT *, epoch_us(ts) AS u, event_id AS turn, value > 40 AS failed,
  lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS p FROM events)"""


def _monitored_cells(spark, sf):
    return event_stream(spark, sf).select(
        "user_id", "event_type", F.col("event_id").alias("turn"), (F.col("value") > 40).alias("failed"), "ts"
    )


@query(
    "streamed_first_failure",
    f"""WITH {CELLS_SQL},
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR u - p > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS sid FROM cells),
    g AS (SELECT user_id, event_type, min(u) AS a, max(u) + 43200000000 AS b, min(turn) FILTER (failed) AS f, max(turn) AS l, count(*) AS n
      FROM s GROUP BY user_id, event_type, sid)
    SELECT user_id, event_type, min(a) // 1000000 AS started, max(b) // 1000000 AS ended, min(f) AS first_failure_turn,
      max(l) AS last_turn, CAST(sum(n) AS BIGINT) AS cells, count(*) AS parts
    FROM g WHERE b <= (SELECT max(epoch_us(ts)) FROM events) - 6 * 3600 * 1000000::BIGINT GROUP BY 1, 2""",
)
def streamed_first_failure(spark, sf):
    """Trajectories silent for twelve hours are closed, emitted and out of the state; returning ones are put together."""
    folder = jobs.work_folder(spark, "first")
    keys = ["user_id", "event_type"]
    watched = jobs.first_failure_monitor(_monitored_cells(spark, sf), keys, "ts", "12 hours", "6 hours")
    jobs.run_available(watched, f"{folder}/out", f"{folder}/log")
    closed = jobs.whole_trajectories(spark.read.schema(watched.schema).parquet(f"{folder}/out"), keys)
    return closed.withColumns({n: F.unix_seconds(n) for n in ("started", "ended")})


@query(
    "streamed_failure_alerts",
    f"WITH {CELLS_SQL} SELECT user_id, event_type, min(turn) AS first_failure_turn FROM cells WHERE failed GROUP BY 1, 2",
)
def streamed_failure_alerts(spark, sf):
    folder = jobs.work_folder(spark, "alerts")
    keys = ["user_id", "event_type"]
    jobs.run_available(
        _monitored_cells(spark, sf), f"{folder}/out", f"{folder}/log", write=jobs.alert_writer(f"{folder}/out", keys)
    )
    return jobs.standing_alerts(spark, f"{folder}/out", keys)


def _rates(spark, sf, keys, **window):
    cells = event_stream(spark, sf).withColumn("failed", F.col("event_type") == "error")
    folder = jobs.work_folder(spark, "rates")
    rates = jobs.windowed_failure_rates(cells, keys, "ts", "6 hours", **window)
    jobs.run_available(rates, f"{folder}/out", f"{folder}/log")
    out = spark.read.parquet(f"{folder}/out")
    return out.select(
        F.unix_seconds("window_start").alias("window_start"), F.unix_seconds("window_end").alias("window_end"),
        *keys, "failed", "total", F.round("failure_rate", 6).alias("failure_rate"),
    )


CLOSED = "window_end * 1000000 <= (SELECT max(epoch_us(ts)) FROM events) - 6 * 3600 * 1000000::BIGINT"
RATE = """count(*) FILTER (event_type = 'error') AS failed, count(*) AS total,
  round(count(*) FILTER (event_type = 'error') / count(*), 6) AS failure_rate"""


@query(
    "streamed_daily_failure_rate",
    f"""WITH w AS (SELECT *, epoch_us(ts) // 86400000000 * 86400 AS window_start, user_id % 5 AS grp FROM events)
    SELECT window_start, window_start + 86400 AS window_end, grp, {RATE} FROM w GROUP BY window_start, grp HAVING {CLOSED}""",
)
def streamed_daily_failure_rate(spark, sf):
    """Only windows closed by the watermark are final and come out."""
    return _grouped(spark, sf, length="1 day")


def _grouped(spark, sf, **window):
    cells = event_stream(spark, sf).withColumns(
        {"failed": F.col("event_type") == "error", "grp": F.col("user_id") % 5}
    )
    folder = jobs.work_folder(spark, "rates")
    rates = jobs.windowed_failure_rates(cells, ["grp"], "ts", "6 hours", **window)
    jobs.run_available(rates, f"{folder}/out", f"{folder}/log")
    return spark.read.parquet(f"{folder}/out").select(
        F.unix_seconds("window_start").alias("window_start"), F.unix_seconds("window_end").alias("window_end"),
        "grp", "failed", "total", F.round("failure_rate", 6).alias("failure_rate"),
    )


@query(
    "streamed_sliding_failure_rate",
    f"""WITH w AS (SELECT *, unnest([epoch_us(ts) // 43200000000 * 43200, epoch_us(ts) // 43200000000 * 43200 - 43200]) AS window_start,
      user_id % 5 AS grp FROM events)
    SELECT window_start, window_start + 86400 AS window_end, grp, {RATE} FROM w GROUP BY window_start, grp HAVING {CLOSED}""",
)
def streamed_sliding_failure_rate(spark, sf):
    return _grouped(spark, sf, length="1 day", slide="12 hours")


@query(
    "streamed_session_failure_rate",
    f"""WITH o AS (SELECT *, epoch_us(ts) AS u, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR u - p > 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM o),
    g AS (SELECT user_id, min(u) AS a, max(u) + 14400000000 AS b, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total FROM s GROUP BY user_id, sid)
    SELECT a // 1000000 AS window_start, b // 1000000 AS window_end, user_id, failed, total, round(failed / total, 6) AS failure_rate
    FROM g WHERE b <= (SELECT max(epoch_us(ts)) FROM events) - 6 * 3600 * 1000000::BIGINT""",
)
def streamed_session_failure_rate(spark, sf):
    return _rates(spark, sf, ["user_id"], gap="4 hours")
