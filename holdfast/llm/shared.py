"""Helpers of the training-data operators: shared folders, text parts, row numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.functions.text import bind

# The white space of the result contracts: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[ \\x09-\\x0D]+"
WORD = "[^ \\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; set here only where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="holdfast-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    Every call takes a new folder, so two runs never meet.  The folders can be removed
    when the results that read them have been written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/holdfast-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole(text: Column | str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK_RUN), "")


def without_blanks(text: Column) -> Column:
    for mark in BLANKS:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def with_binding(value: Column, use: Callable[[Column], Column]) -> Column:
    return bind(value, use)


def numbered(df: DataFrame, key: str, order: Column, spread: Column, name: str, block_rows: int = 50_000) -> DataFrame:
    """0-based gapless numbers inside every ``key``, in blocks, so that no task holds a whole key.

    Rows of a key fall into hash blocks of about ``block_rows``; block totals give each
    block its first number and only the rows of one block are sorted together.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    most = sizes.agg(F.max("_rows")).first()[0] or 0
    blocks = max(1, -(-most // block_rows))
    cut = df.withColumn("_block", F.pmod(F.xxhash64(spread), F.lit(blocks)))
    counts = cut.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_block").orderBy(order)
    ranked = cut.withColumn("_at", F.row_number().over(inside) - 1)
    return (
        ranked.join(starts, [key, "_block"])
        .withColumn(name, F.col("_start") + F.col("_at"))
        .drop("_block", "_start", "_at")
    )
