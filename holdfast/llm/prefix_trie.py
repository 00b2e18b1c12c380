"""Conversation prefix trie by ROLLUP over positional turn columns.

A conversation's turns lie side by side in blocks of ``width`` positions, one column per
position.  ``GROUP BY block, prior, ROLLUP (t1 .. tn)`` makes the nodes of all prefixes of
all blocks in one aggregate: ``prior`` is the node in which the block before ends, and
grouping_id tells how many turns of its block a node has.  A second ROLLUP, over the nodes,
adds up every subtree inside its block and counts children.

``prior`` of every block comes from a doubling scan over block digests, and totals of whole
blocks go up by pointer doubling, so a conversation of n turns takes log2(n / width) rounds.

A turn's id is 16 bytes of the SHA-256 of role and text, followed by the number of words,
which the text determines.  Nothing else of a text is moved.

Defined results: null role or text is empty; turns of equal number (or null number) stand by
their digest and stay as often as they occur; rows without conv_id belong to no
conversation and are left out; an empty table has no root and gives an empty table.  Texts
and conversations of any length are taken whole.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm import shared as sh

MAX_HEAD = 3  # turns that a conversation can take over from another
ID_BYTES = 16
TURN_BYTES = ID_BYTES + 4
ROOT = "00" * ID_BYTES
NULL_SPAN = -(2**62)
ENDS_BITS = 12  # a piece of an id list spans 2^12 ids


def _digest(*parts: Column | str) -> Column:
    """16 bytes of the SHA-256 of parts of fixed length."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, ID_BYTES)


def turn_id(role: Column, text: Column, words: Column) -> Column:
    """Digest of role and text, then the words of the text in four bytes."""
    named = F.concat(F.encode(F.length(role).cast("string"), "utf-8"), F.encode(F.lit(":"), "utf-8"),
                     F.encode(role, "utf-8"), F.encode(text, "utf-8"))
    size = F.unhex(F.lpad(F.hex(words.cast("long")), 8, "0"))
    return F.concat(F.substring(F.unhex(F.sha2(named, 256)), 1, ID_BYTES), size)


def words_of(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, ID_BYTES + 1, 4)), 16, 10).cast("long")


def placed_turns(conversations: DataFrame, span: int = 4096) -> DataFrame:
    """(conv_id, at, turn): turns by their number, null first; ``at`` counts from 1.

    A conversation is cut into spans of turn numbers; totals of earlier spans give each
    span its start, so that no task holds more than a span of a long conversation.
    """
    text, role = sh.whole("text"), sh.whole("role")
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("number"),
        F.coalesce(F.floor(F.col("turn") / span).cast("long"), F.lit(NULL_SPAN)).alias("span"),
        turn_id(role, text, F.size(sh.words(text))).alias("turn"),
    )
    inside = Window.partitionBy("conv_id", "span").orderBy(F.col("number").asc_nulls_first(), "turn")
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("conv_id", "span").agg(F.count(F.lit(1)).alias("rows")).select(
        "conv_id", "span", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    numbered = rows.withColumn("at", F.row_number().over(inside)).drop("number").join(starts, ["conv_id", "span"])
    return numbered.select("conv_id", (F.col("start") + F.col("at")).alias("at"), "turn")


def head_size(conv_id: Column) -> Column:
    """How many turns a conversation takes over."""
    return (F.crc32(F.encode(conv_id.cast("string"), "utf-8")) % (MAX_HEAD + 1)).cast("int")


def rebuilt(turns: DataFrame, family: int = 20) -> DataFrame:
    """Rebuilt turns (conv_id, at, turn, n), ``n`` being all turns of the rebuilt conversation.

    A conversation's head is the start of the first conversation of its family of ids; its
    own turns after as many of its own follow.  One without turns has one row without a turn.
    """
    names = [f"h{i}" for i in range(1, MAX_HEAD + 1)]
    heads = [F.max(F.when(F.col("at") == i, F.col("turn"))).alias(name) for i, name in enumerate(names, 1)]
    own = sh.written(turns.groupBy("conv_id").agg(F.max("at").alias("n_own"), *heads), "trie-heads")
    base = own.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"), *names
    )
    wants = own.select(
        "conv_id", "n_own", head_size(F.col("conv_id")).alias("skip"),
        (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
    )
    taken = F.least("skip", F.coalesce("n_base", F.lit(0))).cast("int")
    plans = wants.join(base, "base", "left").withColumn("taken", taken).select(
        "conv_id", "skip", "taken", (F.col("taken") + F.greatest(F.col("n_own") - F.col("skip"), F.lit(0))).alias("n"),
        F.slice(F.array(*names), F.lit(1), F.col("taken")).alias("head"),
    )
    kept = turns.join(plans.drop("head"), "conv_id").filter(F.col("at") > F.col("skip"))
    rest = kept.select("conv_id", (F.col("at") - F.col("skip") + F.col("taken")).alias("at"), "turn", "n")
    first = plans.select("conv_id", "n", F.posexplode("head").alias("at", "turn"))
    none = plans.filter(F.col("n") == 0).select(
        "conv_id", F.lit(None).cast("long").alias("at"), F.lit(None).cast("binary").alias("turn"), "n"
    )
    return first.select("conv_id", (F.col("at") + 1).alias("at"), "turn", "n").unionByName(rest).unionByName(none)


def _columns(width: int) -> list[str]:
    return [f"t{i + 1}" for i in range(width)]


def blocks_of(turns: DataFrame, width: int) -> DataFrame:
    """One row per conversation and block of positions, with ``prior``, the node in which the block before ends.

    The last column of a full block also carries the node that the block ends in: the
    digest of all turns up to there.
    """
    names = _columns(width)
    slot = F.coalesce((F.col("at") - 1) % width, F.lit(0))
    block = F.coalesce(F.floor((F.col("at") - 1) / width).cast("int"), F.lit(0))
    wide = turns.groupBy("conv_id", block.alias("block")).agg(
        F.max("n").alias("n"), *[F.max(F.when(slot == i, F.col("turn"))).alias(x) for i, x in enumerate(names)]
    )
    here = F.when(F.col(names[-1]).isNotNull(), _digest(*names))
    rows = sh.written(wide.withColumn("after", here), "trie-blocks")
    longest = rows.agg(F.max("block")).first()[0] or 0
    # after(b) covers 2^k blocks up to b.  Only full blocks have one; a block before another is full.
    step = 1
    while step <= longest:
        back = rows.select("conv_id", (F.col("block") + step).alias("block"), F.col("after").alias("earlier"))
        both = F.coalesce(_digest("earlier", "after"), F.when(F.col("earlier").isNull(), F.col("after")))
        joined = rows.join(back, ["conv_id", "block"], "left").withColumn("after", both).drop("earlier")
        rows = sh.written(joined, "trie-scan")
        step *= 2
    if longest:
        back = rows.select("conv_id", (F.col("block") + 1).alias("block"), F.col("after").alias("prior"))
        rows = rows.join(back, ["conv_id", "block"], "left")
    else:
        rows = rows.withColumn("prior", F.lit(None).cast("binary"))
    return rows.withColumn("prior", F.coalesce("prior", F.unhex(F.lit(ROOT)))).withColumn(
        names[-1], F.concat(names[-1], "after")
    ).drop("after")


def _node(width: int, level: Column) -> Column:
    """A node's id from its block's columns."""
    names = _columns(width)
    out = F.when(level == 0, F.col("prior"))
    for j in range(1, width):
        out = out.when(level == j, _digest("prior", *names[:j]))
    return out.when(level == width, F.substring(names[-1], TURN_BYTES + 1, ID_BYTES))


def _last(width: int) -> Column:
    """The turn that a node ends with; null also where a ROLLUP row stands for no node."""
    return F.coalesce(*[F.when(F.col("level") == j, F.col(x)) for j, x in enumerate(_columns(width), 1)])


def _rolled(rows: DataFrame, width: int, sums: str) -> DataFrame:
    """``sums`` per (block, prior) and prefix of the block's columns, for prefixes that are nodes.

    Rows that stop short give groups with null columns, which repeat a shorter prefix.
    A block's empty prefix is a node only at the root; elsewhere it is the last block's end.
    """
    names = ", ".join(_columns(width))
    out = rows.sparkSession.sql(
        f"SELECT block, prior, {names}, {width} - bit_count(grouping_id()) AS level, {sums} "
        f"FROM {{rows}} GROUP BY block, prior, ROLLUP ({names})", rows=rows,
    )
    root = (F.col("level") == 0) & (F.col("block") == 0)
    return out.filter(root | _last(width).isNotNull())


def nodes_of(blocks: DataFrame, width: int) -> DataFrame:
    """One row per node: members, smallest member, whether it is childless, and its own saved tokens."""
    rows = _rolled(blocks, width, "count(1) AS n_convs, min(conv_id) AS conv_id, max(n) AS longest")
    depth = F.col("block").cast("long") * width + F.col("level")
    saved = (F.col("n_convs") - 1) * F.coalesce(words_of(_last(width)), F.lit(0))
    return rows.select(
        "block", "prior", *_columns(width), "level", "n_convs", "conv_id", depth.alias("depth"),
        (F.col("longest") == depth).cast("long").alias("n_leaves"), saved.alias("saved_tokens"),
    )


def totals_below(nodes: DataFrame, width: int) -> DataFrame:
    """(node, kids, leaves, saved): what later blocks add to a node that ends a full block.

    Blocks form a tree of their own; each round adds to every block the sums of those 2^k
    below it, then doubles the reach.
    """
    later = nodes.filter(F.col("block") > 0).groupBy(F.col("prior").alias("node")).agg(
        F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).alias("kids"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("block").alias("block"),
    )
    ends = nodes.filter((F.col("level") == width) & (F.col("block") > 0))
    ends = ends.select(_node(width, F.lit(width)).alias("node"), F.col("prior").alias("up"))
    rows = sh.written(later.join(ends, "node", "left"), "trie-up")
    longest = rows.agg(F.max("block")).first()[0] or 0
    step = 1
    while step < longest:
        more = rows.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("node")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        jumps = rows.select(F.col("node").alias("up"), F.col("up").alias("next"))
        rows = sh.written(
            rows.join(more, "node", "left").join(jumps, "up", "left").select(
                "node", "kids", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), "block", F.col("next").alias("up"),
            ), "trie-up",
        )
        step *= 2
    return rows.select("node", "kids", "leaves", "saved")


def summed_nodes(nodes: DataFrame, width: int) -> DataFrame:
    """Every node with its children, and leaves and saved tokens of its subtree."""
    kids = [f"count_if(level = {j}) AS k{j}" for j in range(1, width + 1)]
    if nodes.filter(F.col("block") > 0).isEmpty():
        rows = nodes.withColumn("kids", F.lit(0).cast("long"))
    else:
        below = totals_below(nodes, width).withColumnRenamed("node", "_end")
        rows = nodes.join(below, F.col("_end") == F.when(F.col("level") == width, _node(width, F.lit(width))), "left")
        rows = rows.withColumn("n_leaves", F.col("n_leaves") + F.coalesce("leaves", F.lit(0))).withColumn(
            "saved_tokens", F.col("saved_tokens") + F.coalesce("saved", F.lit(0))
        ).withColumn("kids", F.coalesce("kids", F.lit(0)))
    # In a prefix's group the prefix itself has the smallest member, the most members and the least depth.
    out = _rolled(
        rows, width, "min(conv_id) AS conv_id, max(n_convs) AS n_convs, min(depth) AS depth, "
        f"sum(n_leaves) AS n_leaves, sum(saved_tokens) AS saved_tokens, max(kids) AS kids, {', '.join(kids)}",
    )
    level = F.col("level")
    inside = F.when(level == width, F.col("kids"))
    for j in range(1, width + 1):
        inside = inside.when(level == j - 1, F.col(f"k{j}"))
    return out.select(
        "conv_id", "depth", "n_convs", inside.alias("n_children"), "n_leaves", "saved_tokens",
        _node(width, level).alias("node"), F.when(level > 0, _node(width, level - 1)).alias("parent"),
    )


def ends_of(blocks: DataFrame, width: int) -> DataFrame:
    """(node, ends_sha256): digest of the ids of the conversations that end in a node, ascending, comma-joined.

    Ids are joined in pieces of neighbouring ids; a node's pieces then run through one
    hash in order.  That step reads a piece at a time and cannot be split, since SHA-256
    is sequential.
    """
    level = sum(F.col(x).isNotNull().cast("int") for x in _columns(width))
    last = blocks.filter(F.col("n") == F.col("block").cast("long") * width + level)
    last = last.select(_node(width, level).alias("node"), "conv_id")
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = last.groupBy("node", F.shiftright("conv_id", ENDS_BITS).alias("piece")).agg(F.array_join(ids, ",").alias("ids"))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, hashlib.sha256()
        done: list[tuple[bytes, str]] = []
        for batch in batches:
            for here, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if here == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = here, hashlib.sha256(ids.encode())
            yield _pairs(done)
            done = []
        if node is not None:
            yield _pairs([(node, digest.hexdigest())])

    ordered = pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids")
    return ordered.mapInArrow(hashed, "node binary, ends_sha256 string")


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.record_batch(
        {"node": pa.array([r[0] for r in rows], pa.binary()), "ends_sha256": pa.array([r[1] for r in rows], pa.string())}
    )


def trie(conversations: DataFrame, width: int = 8) -> DataFrame:
    """One row per distinct prefix of rebuilt conversations."""
    turns = sh.written(placed_turns(conversations), "trie-turns")
    blocks = sh.written(blocks_of(rebuilt(turns), width), "trie-rows")
    nodes = sh.written(nodes_of(blocks, width), "trie-nodes")
    rows = sh.written(summed_nodes(nodes, width), "trie-sums")
    parents = rows.filter(F.col("n_children") > 0).select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")
    )
    none = F.sha2(F.encode(F.lit(""), "utf-8"), 256)
    return rows.join(parents, "parent", "left").join(ends_of(blocks, width), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
