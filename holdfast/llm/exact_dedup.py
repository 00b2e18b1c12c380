"""Exact dedup by an extendible-hash index kept in shared files.

1. ``keys``: one short row per document (id, length, 64-bit hash and SHA-256 of the
   text without blanks), written to the shared folder.
2. ``directory``: the distinct hashes are counted by their leading bits.  While a bucket
   holds more than ``capacity`` hashes the directory doubles; a bucket that fits stays
   at its own, smaller depth.  Copies share one hash, so no split is spent on them.
3. ``addressed``: every key finds its bucket in the directory; nothing below works on a
   key without one.
4. ``chains``: inside a bucket, texts of one hash are told apart by comparing their bytes
   (grouping on bucket, hash and text, combined in every map task, so a hot group sends one
   row per task).  Each different text of a hash is one link of its bucket's chain.
5. ``index``: links that stand for two or more documents, dealt to owner tasks by key
   range, sorted by bucket and hash, written to the shared folder.
6. ``resolve``: every document looks its link up in its bucket; documents without one stand
   alone.  ``keep_first`` takes each chain's best document as it is: whole documents are
   only matched with survivors, by a key of their own, so copies never meet in one task.

Cases: very long texts are taken whole; null text counts as empty, so null, empty and blank texts are one group; a null
doc_id loses against any other; rows that repeat a doc_id with equal text count each in
group_size and exactly one of them is kept; empty tables give empty results; extra
columns are ignored by ``resolve`` and kept by ``keep_first``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm import shared as sh

CAPACITY = 4096
MAX_DEPTH = 40


def _hashed(docs: DataFrame, *more: Column) -> DataFrame:
    text = sh.without_blanks(sh.whole("text"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.length(sh.whole("text")).cast("long").alias("n_chars"),
        text.alias("_norm"), *more,
    ).withColumn("_hash", F.xxhash64("_norm"))


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[int, DataFrame]:
    """Global depth, and a row (prefix, depth, bucket) per slot of the directory.

    Only the size of the fullest bucket comes to the driver.  One step doubles as often
    as evenly spread hashes need, so a large index takes two or three counting jobs.
    """
    distinct = sh.written(keys.select("_hash").distinct(), "hashes")
    depth = 0
    while True:
        slots = distinct.groupBy(_prefix(F.col("_hash"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        fullest = slots.agg(F.max("n")).first()[0] or 0
        if fullest <= capacity or depth >= MAX_DEPTH:
            break
        depth = min(MAX_DEPTH, depth + max(1, math.ceil(math.log2(fullest / capacity))))
    levels = slots.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn(
        "part", F.expr(f"shiftright(slot, {depth} - level)")
    )
    fits = levels.groupBy("level", "part").agg(F.sum("n").alias("total")).filter(
        (F.col("total") <= capacity) | (F.col("level") == depth)
    )
    own = levels.join(fits, ["level", "part"]).groupBy("slot").agg(F.min("level").alias("local_depth"))
    bucket = F.expr(f"shiftleft(shiftright(slot, {depth} - local_depth), {depth} - local_depth)")
    return depth, sh.written(own.withColumn("bucket", bucket), "directory")


def addressed(rows: DataFrame, depth: int, slots: DataFrame) -> DataFrame:
    """Rows with ``_hash`` get the bucket that the directory names for them."""
    named = rows.withColumn("slot", _prefix(F.col("_hash"), depth))
    return named.join(slots.select("slot", "bucket"), "slot").drop("slot")


def chains(docs: DataFrame, depth: int, slots: DataFrame) -> DataFrame:
    """One row per different text: bucket, hash, SHA-256, number of documents and the one that stays.

    The better document of two is the larger value of length * 2^64 - doc_id, a decimal
    that fits a hash aggregate's buffer.
    """
    rank = F.expr(
        "cast(n_chars as decimal(38,0)) * 18446744073709551616BD - "
        "cast(coalesce(cast(doc_id as decimal(20,0)), 9223372036854775808BD) as decimal(38,0))"
    ).cast("decimal(38,0)")
    best = F.expr("cast(_long as decimal(38,0)) * 18446744073709551616BD - _best")
    return (
        addressed(_hashed(docs).withColumn("_rank", rank), depth, slots)
        .groupBy("bucket", "_hash", "_norm")
        .agg(F.max("_rank").alias("_best"), F.max("n_chars").alias("_long"), F.count(F.lit(1)).alias("group_size"))
        .select(
            "bucket", "_hash", F.sha2("_norm", 256).alias("text_sha256"), "group_size",
            F.when(best < F.expr("9223372036854775808BD"), best.cast("long")).alias("keep_id"),
            F.col("_long").alias("keep_chars"),
        )
    )


def build_index(docs: DataFrame, depth: int, slots: DataFrame) -> DataFrame:
    """The shared index: links of two or more documents by bucket, hash and place in the chain."""
    links = sh.written(chains(docs, depth, slots).filter("group_size > 1"), "links")
    chain = Window.partitionBy("bucket", "_hash").orderBy("text_sha256")
    return sh.written(
        links.repartitionByRange("bucket", "_hash").withColumn("chain", F.row_number().over(chain)).select(
            "bucket", "_hash", "chain", "text_sha256", "keep_id", "keep_chars", "group_size"
        ).sortWithinPartitions("bucket", "_hash", "chain"),
        "index",
    )


def _looked_up(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows with (doc_id, n_chars, bucket, _hash, text_sha256) get keep_id, group_size and kept."""
    found = rows.join(index.drop("chain"), ["bucket", "_hash", "text_sha256"], "left")
    return (
        found.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
        .withColumn("_first", F.col("group_size").isNull() | (
            F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
        .drop("keep_chars")
    )


def resolve(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = sh.written(
        _hashed(docs).select("doc_id", "n_chars", "_hash", F.sha2("_norm", 256).alias("text_sha256")), "keys"
    )
    depth, slots = directory(keys, capacity)
    rows = _looked_up(addressed(keys, depth, slots), build_index(docs, depth, slots))
    # Only documents that could stay for their group are numbered: one, and its repeats.
    turn = F.row_number().over(Window.partitionBy("_hash", "text_sha256").orderBy("n_chars"))
    firsts = rows.filter("_first").filter("group_size > 1").withColumn("kept", turn == 1)
    alone = rows.filter("_first").filter("group_size = 1").withColumn("kept", F.lit(True))
    rest = rows.filter("not _first").withColumn("kept", F.lit(False))
    return firsts.unionByName(alone).unionByName(rest).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def keep_first(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents that stay, with their own columns."""
    names = docs.columns
    depth, slots = directory(_hashed(docs).select("_hash"), capacity)
    key = ["_id", "_no_id", "_hash", "n_chars", "text_sha256"]

    def keyed(rows: DataFrame, doc_id: str) -> DataFrame:
        return rows.withColumn("_id", F.coalesce(doc_id, F.lit(0))).withColumn("_no_id", F.col(doc_id).isNull())

    stay = chains(docs, depth, slots).withColumnRenamed("keep_chars", "n_chars")
    stay = sh.written(keyed(stay, "keep_id").select(*key), "survivors")
    packed = _hashed(docs, F.struct(*[F.col(f"`{c}`") for c in names]).alias("_d")).withColumn(
        "text_sha256", F.sha2("_norm", 256)
    ).drop("_norm")
    rows = keyed(packed, "doc_id").join(stay, key, "left_semi")
    # Only repeated rows of one doc_id are left in a key.
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("_d")))
    return rows.withColumn("_turn", turn).filter("_turn = 1").select(*[F.col(f"_d.`{c}`") for c in names])
