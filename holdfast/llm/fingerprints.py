"""Document fingerprints by improbable features.

Every window of 32 bytes has an entropy; the entropy classes that are rare in the whole
corpus make improbable windows.  Among any 32 neighbouring windows the leftmost rarest one
is picked, and a window that is picked often enough becomes a feature.  Features go into
chained Bloom filters of 2048 bits; two fingerprints are compared by the bits that their
filters share beyond what chance gives.

Entropy sums are whole numbers, so equal windows have equal classes wherever they stand,
and equal texts have equal fingerprints in one run (the rarity table is the corpus's own).

Defined results: a null text is empty; an empty text has the empty fingerprint, which is
like another empty one (1.0) and unlike all others (0.0); a text of under 32 bytes is its
own only feature.  Texts of any length are taken whole, long ones in segments, in
linear time but for the comparison, which grows with the product of the numbers of filters.  An empty table
gives an empty table.  Extra columns are ignored.  Rows are ordered by descending doc_id,
null last, rows of one doc_id by text; repeated rows are documents of their own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from holdfast.llm import chunks

WINDOW = 32
STEPS = (1, 2, 4, 8, 16)  # minima over 32 windows by doubling
TOP = 5  # bits of entropy that a window of 32 can have
UNIT = 1 << 24  # one bit of entropy, in whole numbers
CLASSES = 1001
FILTER_BITS = 2048
NULL_KEY = -(2**63)
SEGMENT = 1 << 20  # bytes of a long text that are worked on at once


@dataclass(frozen=True)
class DigestRules:
    """``picked``: how many ranges of 32 windows must choose a window; ``per_filter``: features of one filter."""

    picked: int = 8
    per_filter: int = 160
    hashes: int = 5  # of 16 bits each, 10 at most


@dataclass(frozen=True)
class Digest:
    """Chained filters as whole numbers, with the features that each holds."""

    filters: tuple[int, ...] = ()
    features: tuple[int, ...] = ()

    def text(self) -> str:
        """``count:base64`` per filter, joined by blanks."""
        size = FILTER_BITS // 8
        return " ".join(
            f"{n}:{base64.b64encode(bits.to_bytes(size, 'little')).decode()}"
            for n, bits in zip(self.features, self.filters, strict=True)
        )

    @staticmethod
    def parsed(text: str) -> Digest:
        parts = [p.split(":") for p in text.split()]
        return Digest(
            tuple(int.from_bytes(base64.b64decode(b), "little") for _, b in parts), tuple(int(n) for n, _ in parts)
        )


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1: each filter of the smaller digest with its best partner, weighted by features.

    Of a pair's common bits, those that independent filters would share (and two standard
    deviations more) do not count.
    """
    if a == b:
        return 1.0
    if not a.filters or not b.filters:
        return 0.0
    if (sum(b.features), b.filters) < (sum(a.features), a.filters):
        a, b = b, a
    others = [(f, f.bit_count()) for f in b.filters]
    total = 0.0
    for mine, n in zip(a.filters, a.features, strict=True):
        bits, best = mine.bit_count(), 0.0
        for other, other_bits in others:
            chance = bits * other_bits / FILTER_BITS
            floor, most = chance + 2 * chance**0.5, min(bits, other_bits)
            if most > floor:
                best = max(best, ((mine & other).bit_count() - floor) / (most - floor))
        total += n * best
    return min(1.0, total / sum(a.features))


def _pieces() -> np.ndarray:
    """The part of a window's entropy that a byte value with c places has, for c up to 32."""
    c = np.arange(1, WINDOW + 1)
    return np.concatenate([[0], np.rint(UNIT * c / WINDOW * np.log2(WINDOW / c))]).astype(np.int32)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """The class (0 to 1000) of every window of ``data``, an array of bytes.

    A step to the right takes one byte out and one in; how often each occurs in the window
    is read off the sorted places of its value, whose near neighbours are counted.
    """
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int16)
    pieces = _pieces()
    order = np.argsort(data, kind="stable")
    kind = np.int32 if 256 * (n + WINDOW) < 2**31 else np.int64
    places = data[order].astype(kind) * kind(n + WINDOW) + order.astype(kind)
    after, before = np.ones(n, np.int8), np.zeros(n, np.int8)
    for k in range(1, WINDOW):
        near = (places[k:] - places[:-k] < WINDOW).view(np.int8)
        if not near.any():
            break
        after[:-k] += near
        before[k:] += near
    leaving, entering = np.empty(n, np.int8), np.empty(n, np.int8)
    leaving[order] = after
    entering[order] = before
    steps = np.diff(pieces)
    entropy = np.empty(n - WINDOW + 1, np.int32)
    entropy[0] = pieces[np.bincount(data[:WINDOW], minlength=256)].sum()
    entropy[1:] = steps[entering[WINDOW:]] - steps[leaving[: n - WINDOW] - 1]
    np.cumsum(entropy, out=entropy)
    return (entropy // (TOP * UNIT // (CLASSES - 1) + 1)).astype(np.int16)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, and each text's start and length."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else sizes
    return np.frombuffer(b"".join(texts), np.uint8), starts, sizes


def class_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows that lie inside a text each class has; a long text is cut where windows begin."""
    long = [t for t in texts if len(t) > 2 * SEGMENT]
    if long:
        rest = class_counts([t for t in texts if len(t) <= 2 * SEGMENT])
        cut = (t[a : a + SEGMENT + WINDOW - 1] for t in long for a in range(0, len(t), SEGMENT))
        return rest + sum(class_counts([part]) for part in cut)
    data, starts, sizes = _joined(texts)
    classes = entropy_classes(data)
    inside = np.zeros(len(classes) + 1, np.int32)
    whole = sizes >= WINDOW
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, np.minimum(starts[whole] + sizes[whole] - WINDOW + 1, len(classes)), -1)
    return np.bincount(classes[np.cumsum(inside[:-1]) > 0], minlength=CLASSES)


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of every class, the rarest first, equal counts by class."""
    ranks = np.empty(CLASSES, np.int64)
    ranks[np.lexsort((np.arange(CLASSES), counts))] = np.arange(CLASSES)
    return ranks


@dataclass
class Digester:
    """Digests of texts under one rarity table."""

    ranks: np.ndarray
    rules: DigestRules = field(default_factory=DigestRules)

    def rarest(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For every place the leftmost rarest of its 32 windows inside the same text; the texts' starts."""
        data, starts, sizes = _joined(texts)
        n = len(data)
        place = np.int64(1) << 40
        keys = np.full(n + WINDOW, np.iinfo(np.int64).max)
        classes = entropy_classes(data)
        keys[: len(classes)] = self.ranks[classes] * place + np.arange(len(classes))
        for start, size in zip(starts, sizes, strict=True):  # windows that leave their text
            keys[max(start, start + size - WINDOW + 1) : start + size] = np.iinfo(np.int64).max
        for step in STEPS:
            keys = np.minimum(keys[:-step], keys[step:])
        return keys & (place - 1), starts

    def _long_times(self, text: bytes, ranges: int) -> np.ndarray:
        """How often each window of a long text is chosen, one segment of ranges after another."""
        times = np.zeros(len(text), np.int32)
        for a in range(0, ranges, SEGMENT):
            least, _ = self.rarest([text[a : a + SEGMENT + 2 * WINDOW]])
            chosen = np.bincount(least[: min(SEGMENT, ranges - a)])
            times[a : a + len(chosen)] += chosen
        return times

    def picks(self, texts: list[bytes]) -> list[list[bytes]]:
        """The features of every text, in order."""
        short = [t if len(t) <= 2 * SEGMENT else b"" for t in texts]
        least, starts = self.rarest(short)
        out: list[list[bytes]] = []
        for text, same, start in zip(texts, short, starts, strict=True):
            windows = len(text) - WINDOW + 1
            if windows <= 0:
                out.append([text] if text else [])
                continue
            ranges = max(1, windows - WINDOW + 1)
            times = np.bincount(least[start : start + ranges] - start) if same else self._long_times(text, ranges)
            enough = min(self.rules.picked, ranges, int(times.max()))
            out.append([text[i : i + WINDOW] for i in np.flatnonzero(times >= enough).tolist()])
        return out

    def digests(self, texts: list[bytes]) -> list[Digest]:
        """Each text's distinct features, ``per_filter`` to a filter, all filters of the list at once."""
        features = [dict.fromkeys(f) for f in self.picks(texts)]
        held = [
            tuple(min(self.rules.per_filter, len(f) - i) for i in range(0, len(f), self.rules.per_filter))
            for f in features
        ]
        marks = b"".join(hashlib.sha1(x, usedforsecurity=False).digest() for f in features for x in f)
        bits = np.frombuffer(marks, "<u2").reshape(-1, 10)[:, : self.rules.hashes] % FILTER_BITS
        counts = np.array([n for h in held for n in h], np.int64)
        table = np.zeros((len(counts), FILTER_BITS), np.uint8)
        table[np.repeat(np.arange(len(counts)), counts)[:, None], bits] = 1
        packed = np.packbits(table, axis=1, bitorder="little")
        filters = iter([int.from_bytes(row.tobytes(), "little") for row in packed])
        return [Digest(tuple(next(filters) for _ in h), h) for h in held]


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for batch in batches:
        for part in chunks.slices(batch.column(0).to_pylist()):
            yield [t.encode() for t in part]


def rarity_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks of the entropy classes over all windows of all texts; 1001 sums reach the driver."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for texts in _texts(batches):
            total += class_counts(texts)
        at = np.flatnonzero(total)
        yield pa.record_batch({"class": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    rows = docs.select(F.col(text)).mapInArrow(counted, "class int, n long").groupBy("class").agg(F.sum("n").alias("n"))
    counts = np.zeros(CLASSES, np.int64)
    for row in rows.collect():
        counts[row["class"]] = row["n"]
    return rarity(counts)


def _dealt(docs: DataFrame) -> DataFrame:
    """Rows in parts of neighbouring doc_ids, each part followed by the first row of the part after it.

    Parts are cut at quantiles of the key, four for each shuffle partition; their first
    keys are all that reaches the driver.  A part's rows with its first key go to the part
    before as guests, and those of the topmost part to the last one, which closes the ring.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(
        F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"),
    ).withColumn("_at", F.col("key").cast("double"))
    parts = 4 * partitions
    steps = [i / parts for i in range(1, parts)]
    cuts = keyed.agg(F.percentile_approx("_at", steps, 20 * parts).alias("cuts")).first()["cuts"] or [0.0]
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_at", outputCol="_part").transform(keyed)
    cut = cut.withColumn("part", F.col("_part").cast("int")).drop("_part", "_at")
    firsts = [r for r in cut.groupBy("part").agg(F.max("key").alias("first")).orderBy("part").collect()]
    first_key: list[int | None] = [None] * len(splits)
    goes_to: list[int | None] = [None] * len(splits)
    for row, above in zip(firsts, firsts[1:] + firsts[:1], strict=True):
        first_key[row["part"]] = row["first"]
        goes_to[row["part"]] = above["part"]
    at = F.col("part") + 1
    is_first = F.col("key") == F.element_at(F.lit(first_key).cast("array<long>"), at)
    before = F.element_at(F.lit(goes_to).cast("array<int>"), at)
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(before.alias("part"), F.lit(True).alias("guest"))
    routes = F.when(is_first, F.array(own, guest)).otherwise(F.array(own))
    return (
        cut.select("doc_id", "text", "key", F.explode(routes).alias("to"))
        .select("doc_id", "text", "key", "to.part", "to.guest")
        .repartition(partitions, "part")
        .sortWithinPartitions("part", "guest", F.col("key").desc(), "text")
        .select("doc_id", "text", "part", "guest")
    )


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ("n_features", pa.int64()),
    ]
)


def _row_lists(batches: Iterable[pa.RecordBatch], chars: int = 1_000_000) -> Iterator[list[tuple[Any, ...]]]:
    """Rows in lists of about ``chars`` characters, at least one row each."""
    rows: list[tuple[Any, ...]] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            rows.append(row)
            size += len(row[1])
            if size > chars:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def edited(text: str, after: str) -> str:
    """The last third (rounded down) replaced by the start of the text after it."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def report(docs: DataFrame, rules: DigestRules | None = None) -> DataFrame:
    """Digests of every text and of its edited form, with their likeness and that to the next document.

    Two passes over the texts; the second moves each text once, to its neighbours.
    """
    ranks = rarity_table(docs)
    rules = rules or DigestRules()

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digester = Digester(ranks, rules)
        last: tuple[tuple[Any, str, int, bool], Digest] | None = None
        for rows in _row_lists(batches):
            own = digester.digests([r[1].encode() for r in rows])
            line = ([last] if last else []) + list(zip(rows, own, strict=True))
            pairs = [(a, b) for a, b in zip(line, line[1:]) if a[0][2] == b[0][2] and not a[0][3]]
            changed = [edited(a[0][1], b[0][1]).encode() for a, b in pairs]
            out = []
            for (a, b), text, mark in zip(pairs, changed, digester.digests(changed), strict=True):
                (doc_id, whole, _, _), digest = a
                out.append(
                    (doc_id, len(whole), hashlib.sha256(text).hexdigest(), digest.text(), mark.text(),
                     likeness(digest, mark), likeness(digest, b[1]), sum(digest.features))
                )
            last = line[-1]
            if out:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RESULT, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=RESULT)

    return _dealt(docs).mapInArrow(compared, from_arrow_schema(RESULT))
