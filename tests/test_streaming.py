import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from holdfast.operators import cells as ce
from holdfast.streaming import jobs

SCHEMA = "case_id string, rule_id string, turn long, failed boolean, ts timestamp"


class Feed:
    """A folder that receives one file of JSON lines at a time."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0
        path.mkdir()

    def send(self, rows):
        names = ["case_id", "rule_id", "turn", "failed", "ts"]
        text = "\n".join(json.dumps(dict(zip(names, r))) for r in rows)
        file = self.path / f"{self.n:03d}.json"
        file.write_text(text)
        # The file source reads in order of modification time, to the second.
        os.utime(file, (1_700_000_000 + self.n * 10,) * 2)
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(self.path))


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path / "in")


def test_first_failure_goes_down_for_turns_out_of_order(spark, feed, tmp_path):
    out, log = f"{tmp_path}/out", f"{tmp_path}/log"

    def run():
        stream = jobs.first_failure_stream(feed.stream(), ["case_id", "rule_id"])
        jobs.run_available(stream, out, log, mode="update", write=jobs.upsert_writer(out))
        return {(r.case_id, r.rule_id): r.first_failure_turn for r in jobs.latest_updates(spark, out, ["case_id", "rule_id"]).collect()}

    feed.send([("a", "R1", 5, True, "2026-01-01T00:00:00"), ("a", "R2", 1, False, "2026-01-01T00:00:00")])
    assert run() == {("a", "R1"): 5, ("a", "R2"): None}
    feed.send([("a", "R1", 2, True, "2026-01-01T00:00:00"), ("b", "R1", 9, True, "2026-01-01T00:00:00")])
    feed.send([("a", "R1", 3, False, "2026-01-01T00:00:00")])
    got = run()
    assert got == {("a", "R1"): 2, ("a", "R2"): None, ("b", "R1"): 9}
    batch = spark.read.schema(SCHEMA).json(str(feed.path)).withColumn("pass", ~F.col("failed"))
    want = {(r.case_id, r.rule_id): r.first_failure_turn for r in ce.first_failures(batch, ["case_id", "rule_id"]).collect()}
    assert got == want


def test_resent_runs_are_dropped(spark, feed, tmp_path):
    feed.send([("a", "x", 1, False, "2026-01-01T00:00:00"), ("a", "x", 1, False, "2026-01-01T00:05:00")])
    feed.send([("a", "x", 1, False, "2026-01-01T00:10:00"), ("b", "x", 1, False, "2026-01-01T00:10:00")])
    rows = jobs.deduplicated(feed.stream(), ["case_id"], "ts", "1 hour")
    jobs.run_available(rows, f"{tmp_path}/out", f"{tmp_path}/log")
    assert sorted(r.case_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_last_verdict_wins_across_batches_and_compaction(spark, feed, tmp_path):
    out = f"{tmp_path}/out"
    feed.send([("a", "R1", 1, True, "2026-01-01T00:00:00"), ("a", "R1", 3, False, "2026-01-01T00:00:00")])
    feed.send([("a", "R1", 2, True, "2026-01-01T00:00:00"), ("b", "R1", 1, True, "2026-01-01T00:00:00")])
    key = ["case_id", "rule_id"]
    jobs.run_available(feed.stream(), out, f"{tmp_path}/log", write=jobs.verdict_log_writer(out, key, "turn"))

    def now(path):
        return {r.case_id: (r.turn, r.failed) for r in jobs.current_verdicts(spark, path, key, "turn").collect()}

    assert now(out) == {"a": (3, False), "b": (1, True)}
    jobs.compact_verdicts(spark, out, f"{tmp_path}/compact", key, "turn")
    assert now(f"{tmp_path}/compact") == {"a": (3, False), "b": (1, True)}


def test_late_rows_beyond_the_watermark_are_dropped_and_counted(spark, feed, tmp_path):
    feed.send([("a", "R1", 1, True, "2026-01-01T00:10:00"), ("a", "R1", 2, False, "2026-01-01T00:20:00")])
    feed.send([("a", "R1", 3, False, "2026-01-01T05:00:00")])
    feed.send([("a", "R1", 4, True, "2026-01-01T05:30:00")])
    feed.send([("a", "R1", 5, True, "2026-01-01T00:30:00"), ("a", "R1", 6, True, "2026-01-01T09:00:00")])
    rates = jobs.windowed_failure_rates(feed.stream(), ["rule_id"], "ts", "1 hour", length="1 hour")
    query = jobs.run_available(rates, f"{tmp_path}/out", f"{tmp_path}/log")
    got = {r.window_start.hour: (r.failed, r.total, r.failure_rate) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: (1, 2, 0.5), 5: (1, 2, 0.5)}
    assert jobs.dropped_late_rows(query) == 1


def test_work_folder_uses_the_cluster_setting():
    conf = SimpleNamespace(get=lambda key, default: "/shared/" if key == "spark.checkpoint.dir" else default)
    assert jobs.work_folder(SimpleNamespace(conf=conf), "x").startswith("/shared/x-")


def test_work_folder_is_refused_on_a_cluster_without_the_setting():
    bare = SimpleNamespace(get=lambda key, default: default)
    far = SimpleNamespace(conf=bare, sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        jobs.work_folder(far, "x")


def test_lost_checkpoint_does_not_overwrite_older_verdicts(spark, tmp_path):
    feed, out, key = Feed(spark, tmp_path / "in"), str(tmp_path / "out"), ["case_id"]
    feed.send([("c1", "r", 1, True, "2024-01-01T00:00:00")])
    jobs.run_available(feed.stream(), out, f"{tmp_path}/log1", write=jobs.verdict_log_writer(out, key, "turn"))
    feed.send([("c2", "r", 1, False, "2024-01-01T00:00:00")])
    jobs.run_available(feed.stream(), out, f"{tmp_path}/log2", write=jobs.verdict_log_writer(out, key, "turn"))
    assert sorted(r.case_id for r in jobs.current_verdicts(spark, out, key, "turn").collect()) == ["c1", "c2"]
    assert len(os.listdir(out)) == 2


def test_empty_log_and_unfinished_batches(spark, tmp_path):
    out = str(tmp_path / "none")
    assert jobs.current_verdicts(spark, out, ["case_id"], "turn", "case_id string, turn long").collect() == []
    spark.createDataFrame([("c1", 1)], "case_id string, turn long").write.parquet(f"{out}/query=a/epoch=0")
    spark.createDataFrame([("c9", 1)], "case_id string, turn long").write.parquet(f"{out}/query=a/epoch=1")
    os.remove(f"{out}/query=a/epoch=1/_SUCCESS")
    assert [r.case_id for r in jobs.current_verdicts(spark, out, ["case_id"], "turn").collect()] == ["c1"]


def test_compacted_first_failures(spark, tmp_path):
    feed, out = Feed(spark, tmp_path / "in"), str(tmp_path / "out")
    keys = ["case_id", "rule_id"]
    for turn in (5, 3):
        feed.send([("c1", "r", turn, True, "2024-01-01T00:00:00")])
        stream = jobs.first_failure_stream(feed.stream(), keys)
        jobs.run_available(stream, out, f"{tmp_path}/log", mode="update", write=jobs.upsert_writer(out))
    jobs.compact_updates(spark, out, f"{tmp_path}/small", keys)
    got = jobs.latest_updates(spark, f"{tmp_path}/small", keys).collect()
    assert [r.first_failure_turn for r in got] == [3]


def test_monitor_emits_at_the_end_and_frees_its_state(spark, feed, tmp_path):
    day = "2026-01-0"
    feed.send([("a", "R1", 5, True, f"{day}1T00:00:00"), ("b", "R1", 1, False, f"{day}1T00:10:00")])
    feed.send([("a", "R1", 2, True, f"{day}1T00:20:00"), ("a", "R2", 7, False, f"{day}1T01:00:00")])  # a lower turn comes late
    feed.send([("c", "R1", 3, True, f"{day}1T09:00:00")])
    feed.send([("c", "R1", 4, False, f"{day}1T09:05:00")])
    feed.send([("a", "R1", 1, True, f"{day}1T00:30:00")])  # after the end of its trajectory: dropped
    feed.send([("a", "R1", 9, True, f"{day}2T00:00:00")])  # the trajectory speaks again
    feed.send([("z", "R9", 1, False, f"{day}5T00:00:00")])
    feed.send([("z", "R9", 2, False, f"{day}5T00:01:00")])
    keys = ["case_id", "rule_id"]
    stream = jobs.first_failure_monitor(feed.stream(), keys, "ts", "2 hours", "1 hour")
    query = jobs.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/log")
    closed = spark.read.parquet(f"{tmp_path}/out")
    got = {(r.case_id, r.rule_id, r.first_failure_turn, r.last_turn, r.cells) for r in closed.collect()}
    assert got == {("a", "R1", 2, 5, 2), ("b", "R1", None, 1, 1), ("a", "R2", None, 7, 1), ("c", "R1", 3, 4, 2), ("a", "R1", 9, 9, 1)}
    assert jobs.dropped_late_rows(query) == 1
    held = jobs.state_rows(query)
    assert max(held) >= 3 and held[-1] == 1  # only z is still open
    whole = {(r.case_id, r.rule_id): (r.first_failure_turn, r.cells, r.parts) for r in jobs.whole_trajectories(closed, keys).collect()}
    assert whole[("a", "R1")] == (2, 3, 2)


def test_monitor_goes_on_after_a_restart(spark, feed, tmp_path):
    def run():
        stream = jobs.first_failure_monitor(feed.stream(), ["case_id"], "ts", "1 hour", "1 hour")
        return jobs.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/log")

    feed.send([("a", "R1", 4, True, "2026-01-01T00:00:00")])
    run()
    feed.send([("a", "R1", 3, True, "2026-01-01T00:40:00")])
    feed.send([("b", "R1", 1, False, "2026-01-03T00:00:00")])
    run()
    assert [(r.case_id, r.first_failure_turn) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("a", 3)]


def test_alerts_need_no_state(spark, feed, tmp_path):
    out, keys = f"{tmp_path}/out", ["case_id", "rule_id"]
    feed.send([("a", "R1", 5, True, "2026-01-01T00:00:00"), ("a", "R2", 1, False, "2026-01-01T00:00:00")])
    feed.send([("a", "R1", 3, True, "2020-01-01T00:00:00"), ("b", "R1", None, True, "2026-01-01T00:00:00")])
    query = jobs.run_available(feed.stream(), out, f"{tmp_path}/log", write=jobs.alert_writer(out, keys))
    got = {(r.case_id, r.rule_id): r.first_failure_turn for r in jobs.standing_alerts(spark, out, keys).collect()}
    assert got == {("a", "R1"): 3, ("b", "R1"): None}
    assert set(jobs.state_rows(query)) == {0}
