"""Packing into token windows by order-preserving dynamic programming.

Documents stay in the order in which the table's parts hold them.  A window may end at a
document end, a sentence end, or every ``grid`` tokens inside long sentences; the cost of
a window is its padding plus a penalty for where it ends.  With f the cost up to a cut c,

    f(c) = penalty(c) + size - c + min over cuts a in [c - size, c) of f(a) + a

and the minimum slides along, so a monotone queue finds all cuts of a stream in linear
time.  A task runs the programme over blocks of its stream; what lies behind the best cut
near a block's end goes on into the next block.  Only a task's last window may be short:
it is cut into powers of two, which need no padding.

Token ids come from the tokenizer's ranks, chunk by chunk; they equal those of its JSON
file, whose special strings become their one id.  Every document ends with id 0.

Cases: a null text is one end id; an empty table gives an empty result; null and
repeated doc_ids pass through; a document longer than a block is cut on over several
blocks; extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from holdfast.llm.chunks import MAX_KEPT, MAX_KEPT_CHARS, chunked
from holdfast.llm.token_counts import PATTERN

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, ends string"
)
END_ID = 0
ENDS = ("document", "sentence", "inside")


@dataclass(frozen=True)
class PackRules:
    size: int = 1024
    grid: int = 16
    sentence_penalty: float = 1.0
    inside_penalty: float = 16.0
    block_tokens: int = 1 << 20


class _ChunkIds(dict):
    """Ids of chunks as bytes, made when first met; full, it goes on without keeping more."""

    def __init__(self, work: Callable[[str], bytes]):
        super().__init__()
        self.work = work

    def __missing__(self, chunk: str) -> bytes:
        ids = self.work(chunk)
        if len(self) < MAX_KEPT and len(chunk) <= MAX_KEPT_CHARS:
            self[chunk] = ids
        return ids


class Encoder:
    """Ids of byte-level BPE from a rank file; ``json_path`` gives the special strings."""

    def __init__(self, rank_path: str, json_path: str):
        import tiktoken

        with open(rank_path, "rb") as file:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
        with open(json_path, encoding="utf-8") as file:
            self.special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        own = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = _ChunkIds(lambda c: array("H", own.encode_ordinary(c)).tobytes())
        self.led = _ChunkIds(lambda c: array("H", own.encode_ordinary(" " + c)).tobytes())
        # Tokens after which a sentence may end.
        self.stops = np.zeros(1 << 16, dtype=bool)
        for token, rank in ranks.items():
            self.stops[rank] = token.rstrip(b"\"')").endswith((b".", b"!", b"?", b"\n"))

    def _plain(self, text: str) -> np.ndarray:
        parts = chunked(text)
        head = self.first[parts[0]]
        del parts[0]
        return np.frombuffer(head + b"".join(map(self.led.__getitem__, parts)), np.uint16)

    def encode(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.split(text)
        ids = [self._plain(t) if i % 2 == 0 else np.array([self.special[t]], np.uint16) for i, t in enumerate(parts)]
        return np.concatenate(ids)


def best_cuts(cuts: list[int], penalties: list[float], size: int) -> tuple[list[float], list[int]]:
    """Cost up to every cut, and the cut before it on the cheapest way; cuts[0] is the start."""
    cost, back = [0.0] * len(cuts), [0] * len(cuts)
    queue: deque[tuple[float, int, int]] = deque([(float(cuts[0]), cuts[0], 0)])
    for k in range(1, len(cuts)):
        c = cuts[k]
        while queue[0][1] < c - size:
            queue.popleft()
        low = queue[0]
        f = penalties[k] + size - c + low[0]
        cost[k], back[k] = f, low[2]
        key = f + c
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, c, k))
    return cost, back


class Packer:
    """One task's stream of documents, packed block by block."""

    def __init__(self, stops: np.ndarray, rules: PackRules, first_sequence: int):
        self.stops, self.rules, self.sequence = stops, rules, first_sequence
        self.ids: list[np.ndarray] = []
        self.docs: list[list] = []  # doc_id, tokens of the document before this buffer, its whole length
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(np.append(ids, np.uint16(END_ID)))
        self.docs.append([doc_id, 0, len(ids) + 1])
        self.size += len(ids) + 1

    def full(self) -> bool:
        return self.size >= self.rules.block_tokens

    def pack(self, last: bool) -> list[tuple]:
        """Pieces of the first block; ``last`` packs all that is left."""
        if not self.size:
            return []
        rules, ids = self.rules, np.concatenate(self.ids)
        limit = len(ids) if last else min(len(ids), rules.block_tokens)
        doc_ends = np.cumsum([len(x) for x in self.ids])
        kind = np.full(limit + 1, 3, dtype=np.int8)
        kind[0 : limit + 1 : rules.grid] = 2
        kind[1:][self.stops[ids[:limit]]] = 1
        kind[doc_ends[doc_ends <= limit]] = 0
        kind[0] = 0
        if last:
            kind[limit] = 0
        cuts = np.flatnonzero(kind < 3)
        price = np.array([0.0, rules.sentence_penalty, rules.inside_penalty])[kind[cuts]]
        at = cuts.tolist()
        cost, back = best_cuts(at, price.tolist(), rules.size)
        k = len(at) - 1
        if not last:  # stop at the cheapest cut of the last window, the rest goes on
            low = np.searchsorted(cuts, limit - rules.size // 2)
            k = max(1, low + int(np.argmin(np.array(cost[low:]) + (limit - cuts[low:]) * 1e-6)))
        ends = []
        while k:
            ends.append(at[k])
            k = back[k]
        ends.reverse()
        if last:
            ends = self._powers(ends)
        bounds = np.array([0, *ends], dtype=np.int64)
        pieces = self._pieces(ids, bounds, doc_ends, kind)
        self._drop(int(bounds[-1]), doc_ends)
        return pieces

    def _powers(self, ends: list[int]) -> list[int]:
        """The last window cut into powers of two, large ones first."""
        start = ends[-2] if len(ends) > 1 else 0
        out, length = ends[:-1], ends[-1] - start
        for bit in range(self.rules.size.bit_length(), -1, -1):
            if length >> bit & 1:
                start += 1 << bit
                out.append(start)
        return out

    def _pieces(self, ids: np.ndarray, bounds: np.ndarray, doc_ends: np.ndarray, kind: np.ndarray) -> list[tuple]:
        stop = bounds[-1]
        edges = np.union1d(bounds, doc_ends[doc_ends < stop])
        begins, finishes = edges[:-1], edges[1:]
        window = np.searchsorted(bounds, begins, side="right") - 1
        doc = np.searchsorted(doc_ends, begins, side="right")
        doc_begin = np.concatenate([[0], doc_ends[:-1]])
        wide = memoryview(ids[:stop].astype("<u4")).cast("B")
        out = []
        for b, e, w, d in zip(begins.tolist(), finishes.tolist(), window.tolist(), doc.tolist(), strict=True):
            doc_id, before, total = self.docs[d]
            out.append((
                doc_id, before + b - int(doc_begin[d]), e - b, zlib.crc32(wide[4 * b : 4 * e]), total,
                self.sequence + w, b - int(bounds[w]), ENDS[min(kind[e], 2)],
            ))
        self.sequence += len(bounds) - 1
        return out

    def _drop(self, stop: int, doc_ends: np.ndarray) -> None:
        gone = int(np.searchsorted(doc_ends, stop, side="right"))
        begin = int(doc_ends[gone - 1]) if gone else 0
        self.ids, self.docs = self.ids[gone:], self.docs[gone:]
        if self.ids and stop > begin:
            self.ids[0] = self.ids[0][stop - begin :]
            self.docs[0][1] += stop - begin
        self.size -= stop


def pack(docs: DataFrame, encoder: Callable[[], Encoder], rules: PackRules = PackRules()) -> DataFrame:
    """One row per piece of a document in a sequence.  Texts are read once and not shuffled."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")]

    def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
        columns = zip(*pieces, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        packer = Packer(enc.stops, rules, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                packer.add(doc_id.as_py(), enc.encode(text.as_py() or ""))
                while packer.full():
                    yield batch_of(packer.pack(last=False))
        if pieces := packer.pack(last=True):
            yield batch_of(pieces)

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, SCHEMA)


def file_encoder(rank_path: str, json_path: str) -> Callable[[], Encoder]:
    return lambda: Encoder(rank_path, json_path)
