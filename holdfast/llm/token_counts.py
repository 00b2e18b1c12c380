"""Token counts by rank-synchronous array merging of byte-level BPE.

The new pre-tokens of a batch lie behind one another in one array of symbol ids, with a
sequence number beside each.  Every round looks up the rank of all neighbouring pairs,
takes the lowest rank of each sequence, and merges all its places in all sequences at
once; sequences without a known pair are done and their symbols are counted.  A merge's
result never has a lower rank than the merge, so this equals merging one pair at a time.

Cases: null text has 0 bytes and 0 tokens; an empty table gives an empty result; null
doc_ids and repeated rows pass through; extra columns are ignored; a very long text
without blanks is one chunk and is merged like others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from holdfast.llm.chunks import ChunkTable, slices

# Fixed value: the pre-token pattern of the byte-level tokenizer, with runs made possessive.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"
NO_RANK = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    spare = iter(range(256, 512))
    return [names[b] if b in names else chr(next(spare)) for b in range(256)]


class RankMerger:
    """Merge ranks of one tokenizer file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.width = max(vocab.values()) + 1
        self.byte_ids = np.array([vocab[s] for s in byte_symbols()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged[order]

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols of each piece after all merges."""
        out = np.zeros(len(pieces), dtype=np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        while len(ids):
            at = np.zeros(len(ids), dtype=np.int64)
            rank = np.full(len(ids), NO_RANK)
            inner = np.flatnonzero(seq[:-1] == seq[1:])
            key = ids[inner] * self.width + ids[inner + 1]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[place] == key
            at[inner[known]] = place[known]
            rank[inner[known]] = self.ranks[place[known]]
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lengths = np.diff(np.r_[starts, len(seq)])
            lowest = np.minimum.reduceat(rank, starts)
            ended = lowest == NO_RANK
            out[seq[starts[ended]]] = lengths[ended]
            hit = (rank == np.repeat(lowest, lengths)) & (rank < NO_RANK)
            # Of overlapping places (a a a) every second one is taken, from the left.
            where = np.flatnonzero(hit)
            run = np.r_[True, np.diff(where) > 1] if len(where) else np.zeros(0, dtype=bool)
            first = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0)) if len(where) else where
            where = where[(np.arange(len(where)) - first) % 2 == 0]
            ids[where] = self.merged[at[where]]
            keep = np.repeat(~ended, lengths)
            keep[where + 1] = False
            ids, seq = ids[keep], seq[keep]
        return out


def counter(path: str):
    """``texts -> token counts`` with special strings of the file counted as one token each."""
    merger = RankMerger(path)
    find = regex.compile(PATTERN).findall
    special = regex.compile("|".join(map(regex.escape, merger.special))) if merger.special else None

    def work(chunks: list[str]) -> list[int]:
        pieces = [find(c) for c in chunks]
        distinct = list({p for ps in pieces for p in ps})
        known = dict(zip(distinct, merger.counts([p.encode() for p in distinct]).tolist(), strict=True))
        return [sum(map(known.__getitem__, ps)) for ps in pieces]

    table = ChunkTable(work)

    def count(texts: list[str]) -> list[int]:
        if special is None or not any(s in t for t in texts for s in merger.special):
            return [sum(r) for r in table.results(texts)]
        out = []
        for t in texts:
            parts = special.split(t)
            out.append(len(parts) - 1 + sum(sum(r) for r in table.results(parts)))
        return out

    return count


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n_bytes = [len((t or "").encode()) for t in texts]
            tokens = [n for part in slices(texts) for n in count(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, SCHEMA)
