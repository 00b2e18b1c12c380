"""Streaming versions of scoring, dedupe, verdict merge, first failure and failure rates.

Each job takes a streaming DataFrame and uses the same column expressions as the
batch operators.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from holdfast.functions import rules as rl
from holdfast.operators.records import latest_per_key
from holdfast.sources.readers import matching_paths


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Without one a cluster is refused, because its executors would write to their own
    disks; a local session uses a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="holdfast-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def batch_folder(batch: DataFrame, path: str, epoch: int) -> str:
    """The folder of one micro-batch.  The query's id comes from its checkpoint: a replay
    meets its own folder, a query with a new checkpoint never meets another's."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
    return f"{path}/query={query}/epoch={epoch}"


def finished_batches(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All batch folders that were written to their end; empty if there are none and ``schema`` is given."""
    marks = matching_paths(spark, [f"{path}/query=*/epoch=*/_SUCCESS"])
    if not marks and schema is not None:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", path).parquet(*[m.removesuffix("/_SUCCESS") for m in marks])
    return rows.drop("query", "epoch")


def run_available(
    stream: DataFrame, target: str, checkpoint: str, mode: str = "append",
    write: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Process what is there now and stop; restarts continue from the checkpoint."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if write is None:
        query = writer.format("parquet").option("path", target).start()
    else:
        query = writer.foreachBatch(write).start()
    query.awaitTermination()
    return query


# --- scoring ---------------------------------------------------------------------------


def score_stream(
    responses: DataFrame, rules: Sequence[Mapping[str, object]], active: Callable[[int], Column] | None = None
) -> DataFrame:
    """New responses to score cells; row-local, so no state is kept."""
    return rl.score_cells_static(responses, rules, active=active)


def deduplicated(runs: DataFrame, keys: Sequence[str], time: str, delay: str = "1 day") -> DataFrame:
    """Drop runs sent again within the delay; older keys leave the state."""
    return runs.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


# --- verdict log ------------------------------------------------------------------------


def verdict_log_writer(path: str, keys: Sequence[str], order: str) -> Callable[[DataFrame, int], None]:
    """Per micro-batch: the latest verdict of each slot, in a folder of its own.

    The folder is overwritten if a batch is replayed, so a restart adds nothing twice.
    The cost of a batch depends on the batch, not on the verdicts stored so far.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        latest_per_key(batch, keys, order).write.mode("overwrite").parquet(batch_folder(batch, path, epoch))

    return write


def current_verdicts(
    spark: SparkSession, path: str, keys: Sequence[str], order: str, schema: str | None = None
) -> DataFrame:
    """Last verdict per slot over the whole log."""
    return latest_per_key(finished_batches(spark, path, schema), keys, order)


def compact_verdicts(spark: SparkSession, path: str, target: str, keys: Sequence[str], order: str) -> None:
    """Rewrite the log as one batch in a new place."""
    current_verdicts(spark, path, keys, order).write.mode("errorifexists").parquet(
        f"{target}/query=compacted/epoch=0"
    )


# --- first failure ----------------------------------------------------------------------


def first_failure_stream(cells: DataFrame, keys: Sequence[str], turn: str = "turn", failed: str = "failed") -> DataFrame:
    """First failed turn per trajectory, for update mode, over all time.

    Turns may come out of order: a lower failed turn simply lowers the minimum and the
    group is emitted again.  Every trajectory stays in the state; use
    ``first_failure_monitor`` where trajectories end.
    """
    return cells.groupBy(*keys).agg(F.min(F.when(F.col(failed), F.col(turn))).alias("first_failure_turn"))


def first_failure_monitor(
    cells: DataFrame, keys: Sequence[str], time: str, idle: str, delay: str, turn: str = "turn", failed: str = "failed",
) -> DataFrame:
    """First failed turn per trajectory with state that ends, for append mode.

    A trajectory is over when it was silent for ``idle``; one row comes out when the
    watermark (the latest time less ``delay``) passes that point, and its state is freed.
    Until then turns may come in any order and a lower failed turn lowers the result.
    Cells later than the watermark are dropped and counted (``dropped_late_rows``).  A
    trajectory that speaks again after its end gives a further row; ``whole_trajectories``
    puts these together.  For an answer at the failure itself see ``alert_writer``.
    """
    rows = cells.withWatermark(time, delay)
    watched = rows.groupBy(F.session_window(time, idle).alias("w"), *keys).agg(
        F.min(F.when(F.col(failed), F.col(turn))).alias("first_failure_turn"), F.count(F.lit(1)).alias("cells"),
        F.max(turn).alias("last_turn"),
    )
    return watched.select(
        *keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "first_failure_turn", "last_turn", "cells"
    )


def whole_trajectories(closed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The monitor's rows of one trajectory as one."""
    return closed.groupBy(*keys).agg(
        F.min("started").alias("started"), F.max("ended").alias("ended"),
        F.min("first_failure_turn").alias("first_failure_turn"), F.max("last_turn").alias("last_turn"),
        F.sum("cells").alias("cells"), F.count(F.lit(1)).alias("parts"),
    )


def alert_writer(
    path: str, keys: Sequence[str], turn: str = "turn", failed: str = "failed"
) -> Callable[[DataFrame, int], None]:
    """Per micro-batch the first failed turn of every trajectory that failed in it; no state is kept.

    The minimum over batches is the first failure, so ``standing_alerts`` needs nothing else.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        alerts = batch.filter(F.col(failed)).groupBy(*keys).agg(F.min(turn).alias("first_failure_turn"))
        alerts.write.mode("overwrite").parquet(batch_folder(batch, path, epoch))

    return write


def standing_alerts(spark: SparkSession, path: str, keys: Sequence[str], schema: str | None = None) -> DataFrame:
    """First failed turn of every trajectory that failed so far."""
    rows = finished_batches(spark, path, schema)
    return rows.groupBy(*keys).agg(F.min("first_failure_turn").alias("first_failure_turn"))


def upsert_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Updated groups of each micro-batch in its own folder (see ``latest_updates``)."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("updated", F.lit(epoch)).write.mode("overwrite").parquet(batch_folder(batch, path, epoch))

    return write


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str], schema: str | None = None) -> DataFrame:
    return latest_per_key(finished_batches(spark, path, schema), keys, "updated").drop("updated")


def compact_updates(spark: SparkSession, path: str, target: str, keys: Sequence[str]) -> None:
    """Rewrite the batches so far as one in a new place; batches written there later go above it."""
    rows = latest_updates(spark, path, keys).withColumn("updated", F.lit(-1))
    rows.write.mode("errorifexists").parquet(f"{target}/query=compacted/epoch=0")


# --- failure rates ------------------------------------------------------------------------


def window_of(time: str, length: str, slide: str | None = None, gap: str | None = None) -> Column:
    """Tumbling (length), sliding (length, slide) or session (gap) window."""
    if gap is not None:
        return F.session_window(time, gap)
    return F.window(time, length, slide) if slide else F.window(time, length)


def windowed_failure_rates(
    cells: DataFrame, keys: Sequence[str], time: str, delay: str, length: str = "1 day",
    slide: str | None = None, gap: str | None = None, failed: str = "failed",
) -> DataFrame:
    """failed / total / rate per window and keys; rows later than the delay are dropped."""
    rows = cells.withWatermark(time, delay)
    counted = rows.groupBy(window_of(time, length, slide, gap).alias("w"), *keys).agg(
        F.count_if(F.col(failed)).alias("failed"), F.count(failed).alias("total")
    )
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "failed", "total",
        F.try_divide("failed", "total").alias("failure_rate"),
    )


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows held in the state after each of the query's recent batches."""
    return [sum(op.numRowsTotal for op in p.stateOperators) for p in query.recentProgress]


def dropped_late_rows(query: StreamingQuery) -> int:
    """Rows dropped as too late over the query's recent batches."""
    return sum(
        op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators
    )
