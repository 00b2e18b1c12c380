"""Metrics that a user adds: a start per row group, a merge, a finish.

Every metric runs as two partial aggregates.  Rows are first summed up per key and salt,
so that a key with a third of all rows reaches no task whole; the few states of a key are
then merged.  ``NativeMetric`` states are columns; ``ArrowMetric`` states are rows of a
Python function that sees one Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32
FAN_IN = 256


@dataclass(frozen=True)
class NativeMetric:
    """SQL texts.  ``start``: aggregates over rows; ``merge``: aggregates over the start columns; ``finish``: of these."""

    start: Mapping[str, str]
    merge: Mapping[str, str]
    finish: str


@dataclass(frozen=True)
class ArrowMetric:
    """``start`` and ``merge`` take a key's rows or states and give one state, ``finish`` (SQL) the value of a state.

    ``columns`` are read; ``state`` is the schema of a state without the keys.  A key's
    states are merged ``FAN_IN`` batches at a time.
    """

    columns: Sequence[str]
    state: str
    start: Callable[[pd.DataFrame], Mapping[str, object]]
    merge: Callable[[pd.DataFrame], Mapping[str, object]]
    finish: str


_METRICS: dict[str, NativeMetric | ArrowMetric] = {}


def register_metric(name: str, metric: NativeMetric | ArrowMetric) -> None:
    """Add or replace a metric."""
    _METRICS[name] = metric


def metric_named(name: str) -> NativeMetric | ArrowMetric:
    return _METRICS[name]


def _native(rows: DataFrame, keys: Sequence[str], name: str, metric: NativeMetric) -> DataFrame:
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    started = salted.groupBy(*keys, "_salt").agg(*[F.expr(c).alias(n) for n, c in metric.start.items()])
    merged = started.groupBy(*keys).agg(*[F.expr(c).alias(n) for n, c in metric.merge.items()])
    return merged.select(*keys, F.expr(metric.finish).alias(name))


def _arrow(rows: DataFrame, keys: Sequence[str], name: str, metric: ArrowMetric) -> DataFrame:
    keys, used = list(keys), rows.select(*dict.fromkeys([*keys, *metric.columns]))
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    schema = f"{key_schema}, _part long, {metric.state}"

    def summed(frame: pd.DataFrame, use: Callable[[pd.DataFrame], Mapping[str, object]], part: int) -> pd.DataFrame:
        out = []
        for _, group in frame.groupby(keys, dropna=False, sort=False):
            out.append({**{k: group[k].iloc[0] for k in keys}, "_part": part, **use(group)})
        return pd.DataFrame(out)

    def started(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for frame in frames:
            if len(frame):
                yield summed(frame, metric.start, task)

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        return summed(group, metric.merge, int(group["_part"].iloc[0]))

    states = used.mapInPandas(started, schema)
    some = states.groupBy(*keys, F.floor(F.col("_part") / FAN_IN)).applyInPandas(merged, schema)
    return some.groupBy(*keys).applyInPandas(merged, schema).select(*keys, F.expr(metric.finish).alias(name))


def grouped_metric(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The named metric per group of ``keys``."""
    metric = _METRICS[name]
    return (_native if isinstance(metric, NativeMetric) else _arrow)(rows, keys, name, metric)
