"""Sharding by a k-d tree: nodes are halved at the weighted median of their widest dimension.

A node that must become w shards is cut so that floor(w/2)/w of its bytes go left, until
each leaf is one shard (leaves have reached the target bytes).  The dimensions are
metadata numbers of a document; the widest one has the largest range inside the node,
relative to its range over all documents.  The median is found by counting: bytes are
summed over 8,192 cells of the node's key range, the cell that holds the median is cut
again, until it holds one document.  So a node is never gathered or sorted, and only the
crossing cell of each node comes to the driver.  Equal values of a dimension are told
apart by a hash of the row, so copies, ties and hot sources are split like other rows
(equal texts may land in different shards).

Cases: null text has 0 bytes and counts 1; a very long text is one row of its size, so one shard may exceed the mean by it; null metadata stands below all values;
repeated rows are told apart by a row number; an empty table gives an empty result; more
shards than rows leaves some shards empty; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm import shared as sh

DIMENSIONS = ("_size", "_source", "_lang", "_id")
CELL_BITS = 13
TIE_BITS = 31
KEY_BITS = 31 + TIE_BITS


def _metadata(docs: DataFrame) -> DataFrame:
    text = sh.whole("text")

    def named(column: str) -> Column:
        return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(-1)).cast("double")

    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        named("source").alias("_source"), named("lang").alias("_lang"),
        F.coalesce(F.col("doc_id"), F.lit(-1)).cast("double").alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
    ).withColumn("_size", F.log2(F.col("size").cast("double"))).withColumn(
        "_tie",
        F.shiftleft(F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(1 << 20)), 11)
        + F.pmod(F.xxhash64("_row"), F.lit(1 << 11)),
    )


def _pick(values: list, node: Column, kind: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), node)


def _axis_key(level: DataFrame, axes: list[int], spans: list[tuple[float, float]]) -> Column:
    """Position along the node's axis in the upper bits, the row's tie in the lower ones."""
    node = F.col("_node")
    scaled = [
        F.floor((F.col(d) - F.lit(low)) / F.lit(max(high - low, 1e-9)) * F.lit(float((1 << 31) - 1))).cast("long")
        for d, (low, high) in zip(DIMENSIONS, spans, strict=True)
    ]
    on_axis = F.get(F.array(*scaled), _pick(axes, node, "int"))
    return F.shiftleft(on_axis, TIE_BITS) + F.col("_tie")


def _weighted_cut(rows: DataFrame, wanted: list[int], nodes: int) -> list[int]:
    """Per node the key below which about ``wanted`` bytes lie, by repeated counting."""
    low, before, shift = [0] * nodes, [0] * nodes, max(0, KEY_BITS - CELL_BITS)
    cut: list[int | None] = [None if w > 0 else 0 for w in wanted]
    while True:
        node = F.col("_node")
        start = _pick(low, node, "bigint")
        width = 1 << (shift + CELL_BITS)
        inside = rows.filter(
            _pick([c is None for c in cut], node, "boolean") & (F.col("_key") >= start) & (F.col("_key") - start < width)
        )
        cells = inside.groupBy("_node", F.shiftright(F.col("_key") - start, shift).alias("cell")).agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")
        )
        order = Window.partitionBy("_node").orderBy("cell")
        running = cells.withColumn("upto", F.sum("bytes").over(order) + _pick(before, node, "bigint"))
        goal = _pick(wanted, node, "bigint")
        crossing = running.filter((F.col("upto") >= goal) & (F.col("upto") - F.col("bytes") < goal)).collect()
        for r in crossing:
            k, first = r["_node"], low[r["_node"]] + (r["cell"] << shift)
            under = r["upto"] - r["bytes"]
            if r["n"] == 1 or shift == 0:  # one document crosses the goal: it goes to the nearer side
                cut[k] = first if wanted[k] - under < r["upto"] - wanted[k] else first + (1 << shift)
            else:
                low[k], before[k] = first, under
        for r in range(nodes):
            if cut[r] is None and r not in {x["_node"] for x in crossing}:
                cut[r] = 1 << KEY_BITS
        if all(c is not None for c in cut):
            return cut
        shift = max(0, shift - CELL_BITS)


def assign(docs: DataFrame, shards: int = 16, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document.

    ``target_bytes`` asks for as many shards as keep the mean at or below it.
    """
    rows = sh.written(_metadata(docs), "metadata")
    bounds = rows.agg(F.sum("size").alias("bytes"), *[
        c for d in DIMENSIONS for c in (F.min(d).alias(f"low{d}"), F.max(d).alias(f"high{d}"))
    ]).first()
    if target_bytes:
        shards = max(1, -(-(bounds["bytes"] or 0) // target_bytes))
    spans = [(bounds[f"low{d}"] or 0.0, bounds[f"high{d}"] or 0.0) for d in DIMENSIONS]
    leaves, level = [shards], rows.withColumn("_node", F.lit(0))
    while max(leaves) > 1:
        shape = {r["_node"]: r for r in level.groupBy("_node").agg(F.sum("size").alias("bytes"), *[
            c for d in DIMENSIONS for c in (F.min(d).alias(f"low{d}"), F.max(d).alias(f"high{d}"))
        ]).collect()}  # at most one row per shard
        axes, wanted = [], []
        for k, w in enumerate(leaves):
            r = shape.get(k)
            if r is None or w == 1:
                axes.append(0)
                wanted.append(0 if r is None else r["bytes"] + 1)
                continue
            wide = [(r[f"high{d}"] - r[f"low{d}"]) / max(high - low, 1e-9)
                    for d, (low, high) in zip(DIMENSIONS, spans, strict=True)]
            axes.append(max(range(len(wide)), key=lambda i: (wide[i], -i)))
            wanted.append(r["bytes"] * (w // 2) // w)
        keyed = level.withColumn("_key", _axis_key(level, axes, spans))
        cuts = _weighted_cut(keyed, wanted, len(leaves))
        right = (F.col("_key") >= _pick(cuts, F.col("_node"), "bigint")).cast("int")
        level = keyed.withColumn("_node", F.col("_node") * 2 + right).drop("_key")
        leaves = [x for w in leaves for x in ((w // 2, w - w // 2) if w > 1 else (1, 0))]
        # A leaf keeps its rows on the left; the empty right side asks for nothing.
    number, at = [], 0
    for w in leaves:
        number.append(at)
        at += w
    out = level.select("doc_id", "size", "text_crc32", "_tie", _pick(number, F.col("_node"), "int").alias("shard"))
    return sh.numbered(out, "shard", F.struct("doc_id", "_tie"), F.col("_tie"), "slot")
