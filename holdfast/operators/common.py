"""Building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import fixed_values as fx
from holdfast.functions.text import col

RECORD_KEY = ["case_id", "rep", "model", "temperature"]


def stat(value: Column | str, name: str) -> list[Column]:
    """mean, population std and n; nulls leave all three."""
    value = col(value)
    return [
        F.avg(value).alias(f"{name}_mean"),
        F.stddev_pop(value).alias(f"{name}_std"),
        F.count(value).alias(f"{name}_n"),
    ]


def metric_stats(names: Sequence[str] = fx.METRICS) -> list[Column]:
    return [c for name in names for c in stat(name, name)]


def rate(part: Column | str, whole: Column | str) -> Column:
    """part / whole, null when the whole is zero."""
    return F.try_divide(col(part), col(whole))


def literal_rows(values: Sequence[object]) -> Column:
    """One row per value of a short, fixed list (used instead of cross joins)."""
    return F.explode(F.array(*[F.lit(v) for v in values]))


def grid(anchor: DataFrame, **levels: Sequence[object]) -> DataFrame:
    """Every combination of the fixed levels for each anchor row."""
    out = anchor
    for name, values in levels.items():
        out = out.withColumn(name, literal_rows(values))
    return out


def one_row(df: DataFrame) -> DataFrame:
    """A single-row frame in the same session, the anchor of a pure grid."""
    return df.sparkSession.range(1).select()


def spread(df: DataFrame, *keys: str, parts: int = 64) -> DataFrame:
    """Rows that grow to many each, dealt by key over ``parts`` tasks.

    A small table is read by one task, and all rows made of it would stay there.  The
    number is given, since adaptive execution merges partitions by their few bytes.
    """
    return df.repartition(parts, *keys)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key.  The ``= 1`` filter lets Spark cut each map task
    to one row per key before the shuffle, so a hot key costs no more than others."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def first_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "_rank", parts: int = 64,
) -> DataFrame:
    """The first ``n`` rows of every key, ranked from 1; one plan for every ``n``.

    Rows are first cut inside ``parts`` hash slices of each key, so the last step sees at
    most ``n * parts`` rows of a key however large the key is.
    """
    hashed = [F.col(f"`{name}`") for name, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    part = Window.partitionBy(*keys, "_slice").orderBy(*order)
    rows = (
        df.withColumn("_slice", F.pmod(F.xxhash64(*hashed), F.lit(parts)))
        .withColumn("_part_rank", F.row_number().over(part))
        .filter(F.col("_part_rank") <= n)
        .drop("_slice", "_part_rank")
    )
    whole = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n)


def running_count(
    df: DataFrame, keys: Sequence[str], order: str, condition: Column, name: str, block: int = 4096,
) -> DataFrame:
    """Running count of ``condition`` along an integer order column, per key.

    A key is cut into blocks of ``block`` order values.  Block totals give each block
    its start value, so no task ever holds more than one block of a key's rows.
    """
    cut = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn(
        "_hit", F.coalesce(condition, F.lit(False)).cast("long")
    )
    totals = cut.groupBy(*keys, "_block").agg(F.sum("_hit").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = totals.select(
        *keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        cut.join(starts, [*keys, "_block"])
        .withColumn(name, F.col("_start") + F.sum("_hit").over(inside))
        .drop("_block", "_hit", "_start")
    )


def positions(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], name: str) -> DataFrame:
    """0-based gapless place of every row of a key, ordered by ``block`` and then ``order``.

    Rows are ranked inside one (key, block) only and block totals give each block its
    first place, so a key's rows never meet in one task.
    """
    totals = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, block])],
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    ranked = df.withColumn("_at", F.row_number().over(inside) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, block])]
    return (
        ranked.join(starts, same).withColumn(name, F.col("_start") + F.col("_at"))
        .drop("_at", "_start", *[f"_k{i}" for i in range(len(same))])
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, for display and comparison only."""
    return df.select(
        *[
            F.round(F.col(n), digits).alias(n) if t == "double" else F.col(n)
            for n, t in df.dtypes
        ]
    )
