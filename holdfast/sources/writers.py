"""Table sinks: Parquet, JSON lines, CSV, versioned rewrites, run summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.design import trace_columns, trace_rows
from holdfast.sources.readers import CORRUPT, matching_paths


def write_enriched(records: DataFrame, path: str, partition_by: Sequence[str] = ("model", "temperature")) -> None:
    """Columnar copy that the report queries read, partitioned for pruning."""
    records.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_json_lines(records: DataFrame, path: str) -> None:
    records.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_table_csv(table: DataFrame, path: str, columns: Sequence[str], order: Sequence[str] = ()) -> None:
    """CSV with a fixed column order; nulls become empty fields."""
    rows = table.select(*columns)
    if order:
        rows = rows.orderBy(*order)
    rows.write.mode("errorifexists").option("header", True).option("escape", '"').option("nullValue", "").option(
        "emptyValue", ""
    ).csv(path)


def write_trace_csv(cases: DataFrame, path: str, max_turns: int = 15) -> None:
    """The wide trace table of complete cases with its fixed column list."""
    write_table_csv(trace_rows(cases, max_turns), path, trace_columns(max_turns))


def write_variants(cases: DataFrame, path: str) -> None:
    """One folder per transform variant."""
    cases.write.mode("errorifexists").partitionBy("variant").parquet(path)


def write_summary(spark: SparkSession, path: str, counts: DataFrame, texts: Mapping[str, str]) -> None:
    """One JSON object: the columns of a one-row table plus fixed texts."""
    counts.select("*", *[F.lit(v).alias(k) for k, v in texts.items()]).coalesce(1).write.mode(
        "errorifexists"
    ).json(path)


def write_counted(
    table: DataFrame, counts: Mapping[str, Column], write: Callable[[DataFrame], None],
    kept: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> dict[str, object]:
    """Write ``kept(table)`` and return aggregates over ``table`` observed in the same pass.

    ``counts`` see every row before ``kept`` filters it, so read, quarantined and kept rows
    are known without another scan.
    """
    seen = Observation()
    write(kept(table.observe(seen, *[c.alias(n) for n, c in counts.items()])))
    return dict(seen.get)


def write_with_summary(
    rows: DataFrame, path: str, summary_path: str, texts: Mapping[str, str], counts: Mapping[str, Column] | None = None,
) -> dict[str, object]:
    """Parsed lines as Parquet, and one JSON object with the counters of that pass and fixed texts.

    Lines that did not parse go to ``<path>/quarantined=true`` of the same pass and the
    others to ``quarantined=false``; ``counts`` are further aggregates over all lines.
    """
    broken = F.col(CORRUPT).isNotNull()
    every = {"lines": F.count(F.lit(1)), "quarantined_lines": F.count_if(broken), **(counts or {})}
    marked = rows.withColumn("quarantined", broken)
    seen = write_counted(
        marked, every, lambda df: df.write.mode("errorifexists").partitionBy("quarantined").parquet(path)
    )
    values = rows.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in seen.items()])
    write_summary(rows.sparkSession, summary_path, values, texts)
    return seen


VERSION = "version="


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a table (those whose commit marker exists), oldest first."""
    marks = matching_paths(spark, [f"{path}/{VERSION}*/_SUCCESS"])
    return sorted(int(m.rsplit(VERSION, 1)[1].split("/")[0]) for m in marks)


def write_version(table: DataFrame, path: str, version: int | None = None) -> int:
    """Write the next version next to the old ones; readers switch when it is complete.

    The version being read is never touched, and a failed write leaves no commit marker.
    Of two writers that take the same number the second fails.
    """
    spark = table.sparkSession
    if version is None:
        taken = matching_paths(spark, [f"{path}/{VERSION}*"])
        version = max((int(t.rstrip("/").rsplit(VERSION, 1)[1]) for t in taken), default=0) + 1
    table.write.mode("errorifexists").parquet(f"{path}/{VERSION}{version}")
    return version


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version, or None."""
    known = versions(spark, path)
    return spark.read.parquet(f"{path}/{VERSION}{known[-1]}") if known else None
