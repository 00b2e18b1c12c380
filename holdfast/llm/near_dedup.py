"""Near-duplicates: SuperMinHash signatures, banding, verification on full sets, union-find.

Every shingle of a document draws a pseudo-random permutation of the signature's places.
In step j it offers the value j + (a random fraction) to its j-th place; a place keeps
the least offer.  So one element's ranks are correlated across places and never collide,
which lowers the variance against independent hashes, and a document is done as soon as
all its places are filled, because later steps can only offer more.

Documents with the same shingle set form a class, told by set size and a 128-bit digest;
classes are made once by an aggregate and only their smallest doc_id goes on.
A bucket (one band of equal places) is compared with one head, its member that meets most
others, instead of pair by pair; links are confirmed on the full sets.  What its head
leaves in several components is compared in bounded tiles, first by signatures alone: a
member without a possible link (by component, set sizes and 68 % agreement) ends there.
The others' texts meet in smaller tiles, and only links come out as rows.  Components are found by alternating large-star and small-star
steps on the table of links; nothing of it comes to the driver.

With 42 bands of 6 places a pair at similarity 0.8 shares no bucket with probability
0.000003, and agrees in less than 68 % of 252 places (4.8 standard deviations) with
0.000001; both fall fast above 0.8.

Cases: null or blank text has no shingles, is linked with nothing and stands alone; a
text of one word is one shingle; rows that share a doc_id are one document and link all
classes they are in; very long texts are hashed and compared whole, in slices of a batch;
a row without doc_id has component null and is kept; empty tables give empty results; extra
columns are ignored by ``components`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm import shared as sh
from holdfast.llm.chunks import slices

SIGNATURES = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, places binary"
CLASS = ["set_a", "set_b", "n_shingles"]
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MULTIPLY = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class NearRules:
    words: int = 2
    percent: int = 80
    bands: int = 42
    places: int = 6
    group: int = 256
    tile: int = 512
    sign_tile: int = 4096
    min_agreement: float = 0.68


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MULTIPLY[0]
    x = x ^ (x >> np.uint64(27))
    x = x * MULTIPLY[1]
    return x ^ (x >> np.uint64(31))


def word_list(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000:
            self[word] = value
        return value


class SuperMinHash:
    """Signatures of batches of sets; permutations come from a fixed bank and a rotation."""

    BANK = 4096

    def __init__(self, size: int):
        self.size = size
        order = np.random.default_rng(17).random((self.BANK, size)).argsort(axis=1)
        self.bank = order.astype(np.int64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per set (none empty), equal places for equal least elements."""
        m = self.size
        out = np.full(len(sets) * m, UNSET)
        elements = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        row = (elements >> np.uint64(52)).astype(np.int64)
        turn = ((elements >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        for step in range(m):
            place = self.bank[row, step] + turn
            place -= m * (place >= m)
            slot = owner * m + place
            floor = np.uint64(step << 32)
            free = out[slot] >= floor
            shift = np.uint64(int(GOLDEN) * (step + 1) & 0xFFFFFFFFFFFFFFFF)
            offer = floor | (mixed(elements[free] + shift) >> np.uint64(32))
            np.minimum.at(out, slot[free], offer)
            open_sets = (out.reshape(-1, m) == UNSET).any(axis=1)
            stay = open_sets[owner]
            if not stay.any():
                break
            if not stay.all():
                elements, owner, row, turn = elements[stay], owner[stay], row[stay], turn[stay]
        return out.reshape(-1, m)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, -1)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        key = mixed((key ^ parts[:, :, i]) + GOLDEN)
    return key.view(np.int64)


def shingle_hashes(text: str, hashes: _Hashes, words: int) -> np.ndarray:
    """Distinct 64-bit shingle hashes, sorted."""
    found = word_list(text)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    width = min(words, len(h))
    key = np.full(len(h) - width + 1, np.uint64(width))
    for i in range(width):
        key = mixed((key ^ h[i : len(h) - width + 1 + i]) + GOLDEN)
    return np.unique(key)


def shingle_set(text: str, words: int) -> set:
    found = word_list(text)
    if not found:
        return set()
    return set(zip(*[found[i:] for i in range(min(words, len(found)))], strict=False))


def signed(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """Set size, a 128-bit digest of the set and the band keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketch = _Hashes(), SuperMinHash(rules.bands * rules.places)
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for part in slices(batch.column("text").to_pylist(), 2_000_000):
                sets = [shingle_hashes(t, hashes, rules.words) for t in part]
                sizes = np.array([len(s) for s in sets])
                some = np.flatnonzero(sizes)
                bands, places = [None] * len(part), [None] * len(part)
                if len(some):
                    found = sketch.signatures([sets[i] for i in some])
                    keys, low = band_keys(found, rules.bands), found.astype(np.uint8)
                    for at_some, i in enumerate(some.tolist()):
                        bands[i], places[i] = keys[at_some], low[at_some].tobytes()
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array(sizes, pa.int64()), pa.array(digests[::2]),
                     pa.array(digests[1::2]), pa.array(bands, pa.list_(pa.int64())), pa.array(places, pa.binary())],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "places"],
                )
                at += len(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SIGNATURES)


def verified(pairs: DataFrame, docs: DataFrame, rules: NearRules) -> DataFrame:
    """(a, b, common, total) of every pair, counted on the full sets.

    The partners of one document are dealt to salted groups of about ``group`` rows, each
    with a copy of that document in front, and streamed through the task.
    """
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    dealt = sh.written(
        pairs.join(sizes, "a").withColumn(
            "salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("_n") / rules.group).cast("long"))
        ).select("a", "b", "salt"),
        "pairs",
    )
    heads = dealt.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("id"), F.lit(0).alias("turn"))
    rows = heads.unionByName(dealt.select("a", "salt", F.col("b").alias("id"), F.lit(1).alias("turn")))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null and text is not null")
    # Always a shuffle of the texts: they are dealt out once, whatever the number of pairs.
    streams = rows.hint("merge").join(texts, "id").repartition("a", "salt").sortWithinPartitions("a", "salt", "turn")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, front = None, []
        for frame in frames:
            out = []
            for a, salt, b, turn, text in zip(
                frame["a"], frame["salt"], frame["id"], frame["turn"], frame["text"], strict=True
            ):
                own = shingle_set(text, rules.words)
                if turn == 0:
                    if key != (a, salt):
                        key, front = (a, salt), []
                    if own not in front:
                        front.append(own)
                    continue
                for other in front:
                    common = len(own & other)
                    out.append((a, b, common, len(own) + len(other) - common))
            yield pd.DataFrame(out, columns=["a", "b", "common", "total"])

    return streams.mapInPandas(run, "a bigint, b bigint, common bigint, total bigint")


def star_components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable, for all ids of links (a, b) but the roots.

    Large-star hangs a node's larger neighbours below its least neighbour, small-star does
    so for the smaller ones; both keep components and end in stars.
    """
    edges = sh.written(links.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = large.distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(root, "u")
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            root.select("u", F.col("m").alias("v"))
        ).distinct()
        edges = sh.written(small, "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


def _near_in_size(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def set_classes(sigs: DataFrame) -> DataFrame:
    """One row per different set: smallest doc_id ``rep``, rows, and its signature.

    Equal sets have equal signatures, so copies meet in map-side aggregates and no join
    ever brings the rows of a hot set together.
    """
    return sigs.filter("n_shingles > 0 and doc_id is not null").groupBy(*CLASS).agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
        F.first("bands").alias("bands"), F.first("places").alias("places"))


def with_class(rows: DataFrame, classes: DataFrame, value: str, hot_classes: int = 10_000) -> DataFrame:
    """``rows`` with their class's ``value`` (null without a class).

    Classes of more than a ``hot_classes``-th of all rows, hence fewer than ``hot_classes``,
    are broadcast; all others are joined by a shuffle.
    """
    floor = classes.agg(F.ceil(F.sum("copies") / hot_classes)).first()[0] or 0
    hot = classes.filter(F.col("copies") > max(floor, 1000)).select(*CLASS, F.col(value).alias("_hot"))
    cold = classes.filter(F.col("copies") <= max(floor, 1000)).select(*CLASS, value)
    split = rows.join(F.broadcast(hot), CLASS, "left")
    rest = split.filter("_hot is null").drop("_hot").join(cold, CLASS, "left")
    return rest.unionByName(split.filter("_hot is not null").withColumnRenamed("_hot", value))


def same_id_links(sigs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): a doc_id that occurs with several sets, linked with every class it is in."""
    several = sigs.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(
        F.min(F.struct(*CLASS)).alias("_low"), F.max(F.struct(*CLASS)).alias("_high")
    ).filter("_low != _high").select("doc_id")
    held = sigs.select("doc_id", *CLASS).join(several, "doc_id").filter("n_shingles > 0").distinct()
    return held.join(classes.select(*CLASS, "rep"), CLASS).filter("rep != doc_id").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def links_between(sigs: DataFrame, docs: DataFrame, rules: NearRules) -> tuple[DataFrame, DataFrame]:
    """Class table and components (id, root) of the classes' representatives."""
    classes = sh.written(set_classes(sigs), "classes")
    banded = classes.select("rep", "set_a", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(
        F.min("rep").alias("_first"), F.max("rep").alias("_last"), F.count(F.lit(1)).alias("_size")
    ).filter("_first != _last").select("band", "_size")
    found = sh.written(banded.join(shared, "band").distinct(), "buckets")
    # The head of a bucket is its member that meets most others in all its buckets: the
    # text that the others were made from rather than one of them.
    hubs = found.groupBy("rep").agg(F.sum("_size").alias("_hub"))
    top = found.join(hubs, "rep").groupBy("band").agg(F.max(F.struct(F.col("_hub"), (-F.col("rep")).alias("_low"))).alias("_top"))
    heads = top.select("band", (-F.col("_top._low")).alias("head"))
    members = sh.written(found.drop("_size").join(heads, "band"), "members")

    front = members.filter("rep = head").select("band", F.col("n").alias("head_n"))
    pairs = (
        members.filter("rep != head").join(front, "band")
        .filter(_near_in_size(F.col("n"), F.col("head_n"), rules.percent))
        .select(F.col("head").alias("a"), F.col("rep").alias("b"))
    )
    first = sh.written(verified(pairs.distinct(), docs, rules), "checked")
    links = first.filter(F.col("common") * 100 >= F.col("total") * rules.percent).select("a", "b").unionByName(
        same_id_links(sigs, classes))
    roots = star_components(links)
    placed = members.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    open_buckets = placed.groupBy("band").agg(
        F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("_size")
    ).filter("_low != _high").select("band", "_size")
    signs = classes.select("rep", "set_a", "bands", "places")
    apart = placed.join(open_buckets, "band").join(signs, ["rep", "set_a"])
    likely = sh.written(likely_members(apart, rules), "likely")
    more = sh.written(tile_links(likely, docs, rules), "more")
    if more.isEmpty():
        return classes, roots
    return classes, star_components(links.unionByName(more))


class _Tile:
    """Signatures of the members of one group of tiles."""

    def __init__(self, rows: pd.DataFrame, rules: NearRules):
        self.rules, self.band = rules, rows["band"].iloc[0]
        self.rep, self.n, self.own = (rows[c].to_numpy() for c in ("rep", "n", "own"))
        self.root = rows["root"].to_numpy().copy()
        self.places = np.frombuffer(b"".join(rows["places"]), np.uint8).reshape(len(rows), -1)
        self.bands = np.stack(rows["bands"].to_numpy())
        self.both = rows["x"].iloc[0] != rows["y"].iloc[0]
        self.least = int(rules.min_agreement * rules.bands * rules.places)

    def after(self, i: int) -> np.ndarray:
        """Later members that may be links of member ``i`` and meet it first in this bucket."""
        at = i + 1 + np.flatnonzero(
            (self.root[i + 1 :] != self.root[i])
            & (np.minimum(self.n[i + 1 :], self.n[i]) * 100 >= np.maximum(self.n[i + 1 :], self.n[i]) * self.rules.percent)
            & ((self.own[i + 1 :] != self.own[i]) if self.both else True)
        )
        at = at[(self.places[at] == self.places[i]).sum(axis=1) >= self.least]
        return at[self.bands[at, (self.bands[at] == self.bands[i]).argmax(axis=1)] == self.band]


def _tiled(members: DataFrame, tile: int) -> DataFrame:
    """Members of buckets of ``_size`` dealt to tiles of about ``tile``; every two tiles (x, y) meet."""
    return (
        members.withColumn("_tiles", F.ceil(F.col("_size") / tile).cast("long"))
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("_tiles")))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)))
        .withColumns({"x": F.least("own", "_other"), "y": F.greatest("own", "_other")})
        .select("band", "x", "y", "own", "rep", "set_a", "n", "root", "places", "bands")
    )


def _groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole (band, x, y) groups of a sorted stream."""
    rest = None
    for frame in frames:
        rest = frame if rest is None else pd.concat([rest, frame])
        groups = [g for _, g in rest.groupby(["band", "x", "y"], sort=False)]
        yield from groups[:-1]
        rest = groups[-1] if groups else None
    if rest is not None:
        yield rest


def likely_members(apart: DataFrame, rules: NearRules) -> DataFrame:
    """Members of open buckets that have a possible link in another component, by signatures alone.

    No text moves here and at most one row per member and group comes out.
    """
    columns = ["band", "rep", "set_a", "n", "root", "places", "bands"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(frames):
            tile, some = _Tile(rows, rules), np.zeros(len(rows), bool)
            for i in range(len(rows) - 1):
                at = tile.after(i)
                some[at] = True
                some[i] |= len(at) > 0
            yield rows.loc[some, columns]

    met = _tiled(apart, rules.sign_tile).repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    found = met.mapInPandas(
        run, "band bigint, rep bigint, set_a bigint, n bigint, root bigint, places binary, bands array<bigint>")
    return found.dropDuplicates(["band", "rep", "set_a"])


def tile_links(likely: DataFrame, docs: DataFrame, rules: NearRules) -> DataFrame:
    """(a, b): confirmed links between members of a bucket that lie in different components.

    Groups of two tiles are bounded; a pair is looked at in the first bucket it shares and
    the full sets decide.  Only links come out as rows.
    """
    sizes = likely.groupBy("band").agg(F.count(F.lit(1)).alias("_size"))
    met = _tiled(likely.join(sizes, "band"), rules.tile)
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").filter("rep is not null and text is not null")

    def links_of(rows: pd.DataFrame) -> pd.DataFrame:
        tile, texts = _Tile(rows, rules), rows["text"].tolist()
        root, sets, found = tile.root, {}, []

        def set_of(i: int) -> set:
            if i not in sets:
                sets[i] = shingle_set(texts[i], rules.words)
            return sets[i]

        for i in range(len(rows) - 1):
            for j in tile.after(i).tolist():
                if root[i] == root[j]:
                    continue
                common = len(set_of(i) & set_of(j))
                if common * 100 >= (len(sets[i]) + len(sets[j]) - common) * rules.percent:
                    found.append((tile.rep[i], tile.rep[j]))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(links_of, _groups(frames))

    streams = met.hint("merge").join(texts, "rep").repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    return streams.mapInPandas(run, "a bigint, b bigint")


def components(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sigs = sh.written(signed(docs, rules), "signatures")
    classes, roots = links_between(sigs, docs, rules)
    placed = classes.select(*CLASS, "rep", "copies").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    placed = sh.written(placed.select(*CLASS, "copies", F.coalesce("root", "rep").alias("component_id")), "placed")
    rows = with_class(sigs.select("doc_id", *CLASS), placed, "component_id")
    rows = rows.select("doc_id", "n_shingles", F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """The documents with the smallest doc_id of their component, with their own columns."""
    gone = components(docs, rules).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    packed = docs.select(
        F.col("doc_id").cast("long").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"))
    kept = packed.join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    return kept.select(*[F.col(f"_d.`{c}`") for c in docs.columns])
