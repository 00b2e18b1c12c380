"""A large JSON array read by many tasks.

The file is read as lines that end with ``}``, which Spark splits at any byte.  What such a
piece does to a parser depends only on whether it starts inside a text: its quotes flip
that state, and its brackets outside of texts change the depth.  Flips and depths are added
up inside each split and then over the splits, so every piece learns the state and depth it
starts with, and the pieces of one element of the array come together to be parsed.

Elements must be objects.  One element is held in one row, as it is in the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.sources.readers import CORRUPT

ESCAPED = r"\\."
TEXTS = r'"[^"]*"'
UNCLOSED = r'"[^"]*$'
REST = r'^[^"]*"'
BEFORE = "^[\\s,\\[﻿]*"


def _count(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("long")


def _running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier pieces of the file: inside the split, and of the splits before."""
    totals = rows.groupBy("file", "split").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", "split", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("file", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_here", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(starts, ["file", "split"]).withColumn(name, F.col("_start") + F.col("_here")).drop("_start", "_here")


def array_elements(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(file, element, json): the text of every object of the arrays, numbered from 0 per file."""
    pieces = spark.read.option("lineSep", "}").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("piece"),
    )
    plain = F.regexp_replace("piece", ESCAPED, "")
    pieces = pieces.withColumns({"_plain": plain}).withColumn("_quotes", _count(F.col("_plain"), '"'))
    known = _running(pieces, "_quotes", "_before").withColumn("_inside", F.col("_before") % 2 == 1)
    from_out = F.when(F.col("_inside"), F.regexp_replace("_plain", REST, "")).otherwise(F.col("_plain"))
    still_inside = F.col("_inside") & (F.col("_quotes") == 0)
    outer = F.when(still_inside, F.lit("")).otherwise(F.regexp_replace(F.regexp_replace(from_out, TEXTS, ""), UNCLOSED, ""))
    # The piece's own } counts unless it stands inside a text.
    ends = (F.col("_before") + F.col("_quotes")) % 2 == 0
    known = known.withColumn("_outer", outer).withColumn("_opens", _count(F.col("_outer"), "{")).withColumns(
        {
            "_closes": ends.cast("long"), "_brackets": _count(F.col("_outer"), "[") - _count(F.col("_outer"), "]"),
        }
    )
    known = known.withColumn("_change", F.col("_opens") - F.col("_closes")).drop("_plain", "_outer", "_quotes", "_before")
    # Braces alone tell where an element of an array of objects ends: back at none open.
    depth = _running(known, "_change", "_depth").withColumn(
        "_last", ((F.col("_closes") == 1) & (F.col("_depth") + F.col("_change") == 0)).cast("long")
    )
    numbered = _running(depth, "_last", "element")
    ordered = F.array_sort(F.collect_list(F.struct("split", "row", "piece")))
    text = F.array_join(F.transform(ordered, lambda p: p["piece"]), "}")
    rows = numbered.groupBy("file", "element").agg(
        F.regexp_replace(text, BEFORE, "").alias("_text"), F.max("_last").alias("_whole"), F.sum("_opens").alias("_opens"),
    )
    # What follows the last element is the array's end; anything with an opening brace is a broken element.
    whole = F.when(F.col("_whole") == 1, F.concat("_text", F.lit("}"))).otherwise(F.col("_text"))
    return rows.filter((F.col("_whole") == 1) | (F.col("_opens") > 0)).select("file", "element", whole.alias("json"))


def read_json_array(spark: SparkSession, paths: Sequence[str] | str, schema: str) -> DataFrame:
    """The arrays' objects with a schema; those that do not parse are kept in ``_corrupt_record``."""
    rows = array_elements(spark, paths)
    parsed = F.from_json("json", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    return rows.select("file", "element", parsed.alias("_v")).select("file", "element", "_v.*")
