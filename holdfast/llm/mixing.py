"""Mixing sources to target weights by cube-method balanced sampling.

Targets: sources in code-point order (null last) weigh ``weights``, repeating, and share
``share`` of all sizes; a source's target stops at ``most`` times its size and the excess
goes to the others by weight until none is above.  A document enters floor(r) times, with
r its source's target over size, and once more with probability r - floor(r).

The cube method draws these extra copies so that both the tokens and the number of
documents stay on target: of three undecided documents the probabilities move along the
direction that changes neither sum, up or down at random so that their expectation stays,
until one is decided.  It runs in blocks of a source in parallel; a block leaves at most
two undecided documents, which meet in blocks of blocks, until one block per source is
left; its last two are landed on the roundings nearest the token target, and exchanges in
that block mend what is left of the error.  Draws are
seeded by source and block, so reruns agree.

Cases: null text has size 0; sources may be null; rows that repeat id, source and size
are one unit and get equal copies; a null doc_id is a unit per source and size; an empty
table gives an empty result; a table of empty texts has targets of 0 and takes nothing;
extra columns are ignored by ``plan`` and kept by ``mix``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm import shared as sh


@dataclass(frozen=True)
class MixRules:
    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: float = 2.0
    block: int = 8192


def size_of(text: str) -> Column:
    return F.regexp_count(sh.whole(text), F.lit(sh.WORD)).cast("long")


def source_targets(sizes: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """source, source_size, target and documents, one row per source.

    Sources are ordered by how soon their limit binds; a source is full if, with all
    before it full, the level of the rest would lift it above its limit.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    every = Window.partitionBy()
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weights = F.array(*[F.lit(float(w)) for w in rules.weights])
    limit = F.col("source_size") * rules.most
    ranked = sources.withColumn(
        "_w", F.get(weights, ((F.row_number().over(by_name) - 1) % len(rules.weights)))
    ).withColumn("_limit", limit).withColumn("_all", F.sum("source_size").over(every) * rules.share)
    order = Window.orderBy(F.col("_limit") / F.col("_w"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_all") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    levels = ranked.withColumn("_level", level).withColumn("_full", F.col("_level") * F.col("_w") > F.col("_limit"))
    # The level of the first source that is not full holds for all that are not; later ones are lower.
    free = F.max(F.when(~F.col("_full"), F.col("_level"))).over(every)
    target = F.when(F.col("_full"), F.col("_limit")).otherwise(F.least(F.col("_limit"), free * F.col("_w")))
    return levels.withColumn("target", target).select("source", "source_size", "n_docs", "target")


def flight(sizes: np.ndarray, chances: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Moves the probabilities until at most two documents are undecided."""
    p = chances.astype(float).tolist()
    s = sizes.astype(float).tolist()
    active: list[int] = []
    upcoming = iter(range(len(p)))
    coins = iter(draw.random(2 * len(p) + 8).tolist())

    def move(units: list[int], u: tuple[float, ...]) -> list[int]:
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(units, u, strict=True) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(units, u, strict=True) if d)
        step = up if next(coins) * (up + down) < down else -down
        for i, d in zip(units, u, strict=True):
            p[i] += step * d
            p[i] = 0.0 if p[i] < 1e-9 else 1.0 if p[i] > 1 - 1e-9 else p[i]
        return [i for i in units if 0 < p[i] < 1]

    while True:
        while len(active) < 3 and (i := next(upcoming, None)) is not None:
            if 0 < p[i] < 1:
                active.append(i)
        if len(active) < 2:
            break
        if len(active) == 2:
            if s[active[0]] != s[active[1]]:
                break
            active = move(active, (1.0, -1.0))
            continue
        a, b, c = (s[i] for i in active)
        if a == b == c:
            active = move(active[:2], (1.0, -1.0)) + active[2:]
        else:
            scale = max(abs(b - c), abs(c - a), abs(a - b))
            active = move(active, ((b - c) / scale, (c - a) / scale, (a - b) / scale))
    return np.array(p)


def landing(sizes: np.ndarray, p: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Rounds the undecided (at most two) so that the tokens stay nearest to expectation.

    What is still off is mended by exchanging a drawn unit for one not drawn, the pair
    whose sizes differ nearest by the error, as long as that helps (three times at most).
    """
    out, open_at = p.copy(), np.flatnonzero((p > 0) & (p < 1))
    want = float((sizes[open_at] * p[open_at]).sum())
    options = [[b >> k & 1 for k in range(len(open_at))] for b in range(1 << len(open_at))]
    best = min(options, key=lambda o: (
        abs(float((sizes[open_at] * o).sum()) - want), abs(sum(o) - float(p[open_at].sum())), o))
    out[open_at] = best
    for _ in range(3):
        error = float((sizes * (out - chances)).sum())
        ins, outs = np.flatnonzero(out == 1), np.flatnonzero(out == 0)
        if not len(ins) or not len(outs) or error == 0:
            break
        outs = outs[np.argsort(sizes[outs], kind="stable")]
        wanted = sizes[ins] - error
        at = np.clip(np.searchsorted(sizes[outs], wanted), 0, len(outs) - 1)
        left = np.maximum(at - 1, 0)
        at = np.where(np.abs(sizes[outs[left]] - wanted) <= np.abs(sizes[outs[at]] - wanted), left, at)
        gap = np.abs(sizes[outs[at]] - wanted)
        i = int(np.argmin(gap))
        if gap[i] >= abs(error):
            break
        out[ins[i]], out[outs[at[i]]] = 0.0, 1.0
    return out


def _drawn(units: DataFrame, last: bool) -> DataFrame:
    """Flight phase of every (stratum, block), and the landing in the last round."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["weight", "unit"], ascending=[False, True])
        seed = zlib.crc32(f"{frame['stratum'].iloc[0]}:{frame['block'].iloc[0]}:{len(frame)}".encode())
        sizes = frame["weight"].to_numpy()
        p = flight(sizes, frame["chance"].to_numpy(), np.random.default_rng(seed))
        if last:
            p = landing(sizes, p, frame["chance"].to_numpy())
        return frame.assign(chance=p)

    kinds = ", ".join(f"{n} {t}" for n, t in units.dtypes)
    return units.groupBy("stratum", "block").applyInPandas(run, kinds)


def drawn_copies(units: DataFrame, blocks: int, rules: MixRules) -> DataFrame:
    """(unit, weight, extra 0 or 1) of units (stratum, unit, weight, chance, blocks); ``blocks`` is the largest."""
    rows = units.withColumn("block", F.pmod(F.col("unit"), F.col("blocks")).cast("int"))
    first = sh.written(_drawn(rows.drop("blocks"), blocks == 1), "flight")
    if blocks == 1:
        return first.select("unit", "weight", F.col("chance").cast("int").alias("extra"))
    rest = first.filter("chance > 0 and chance < 1")
    done = first.filter("chance = 0 or chance = 1").select("unit", "weight", "chance")
    while blocks > 1:
        blocks = -(-blocks // (rules.block // 2))
        moved = sh.written(_drawn(rest.withColumn("block", F.pmod(F.col("block"), F.lit(blocks))), blocks == 1), "flight")
        done = done.unionByName(moved.filter("chance = 0 or chance = 1").select("unit", "weight", "chance"))
        rest = moved.filter("chance > 0 and chance < 1")
    return done.select("unit", "weight", F.col("chance").cast("int").alias("extra"))


KEY = ("doc_id", "source", "size")


def _same(left: DataFrame, right: DataFrame, names: tuple[str, ...], how: str) -> DataFrame:
    """Join on columns that may be null; the right side's columns are dropped."""
    renamed = right.select(*[F.col(n).alias(f"_r_{n}") if n in names else F.col(n) for n in right.columns])
    on = [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names]
    return left.join(renamed, on, how).drop(*[f"_r_{n}" for n in names])


def decided(sizes: DataFrame, rules: MixRules = MixRules()) -> tuple[DataFrame, DataFrame]:
    """Copies per (doc_id, source, size), and the table of sources."""
    sources = sh.written(source_targets(sizes, rules), "sources")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = sources.withColumn("_ratio", F.round(ratio, 12)).select(
        "source", F.floor("_ratio").cast("int").alias("base"), (F.col("_ratio") - F.floor("_ratio")).alias("chance"),
        F.xxhash64("source").alias("stratum"),
        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / rules.block)).cast("int").alias("blocks"),
    )
    units = sizes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"))
    rated = sh.written(
        _same(units, rates, ("source",), "inner")
        .withColumn("unit", F.xxhash64("doc_id", "source", "size")).withColumn("weight", F.col("size") * F.col("rows")),
        "units",
    )
    blocks = rates.agg(F.max("blocks")).first()[0] or 1
    free = rated.filter("chance > 0").select("stratum", "unit", "weight", "chance", "blocks")
    extra = drawn_copies(free, blocks, rules)
    copies = rated.join(extra, ["unit", "weight"], "left").select(
        *KEY, (F.col("base") + F.coalesce("extra", F.lit(0))).alias("copies"))
    return copies, sources


def plan(docs: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sizes = sh.written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of("text").alias("size")), "sizes")
    copies, sources = decided(sizes, rules)
    rows = _same(_same(sizes, copies, KEY, "inner"), sources, ("source",), "inner")
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mix(docs: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with its own columns."""
    packed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", size_of("text").alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"))
    sizes = sh.written(packed.drop("_d"), "sizes")
    copies, _ = decided(sizes, rules)
    rows = _same(packed, copies.filter("copies > 0"), KEY, "inner")
    repeated = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col(f"_d.`{c}`") for c in docs.columns])
