"""Language identification by nearest centroid over TF-IDF vectors of hashed byte n-grams.

A text's vector counts the byte trigrams of its letters (lower-cased UTF-8) in ``dimensions`` hash
cells, damped by a logarithm, weighted by inverse document frequency and scaled to unit
length.  Document frequencies cover all learning documents.  Each language has a few
centroids, found by spherical k-means on a bounded sample of its learning documents.  A
text takes the language of the centroid with the largest cosine; it counts as rejected
when that cosine is lower than all but ``reject_share`` of the language's own sample
had, or when no learned language exists.

Cases: very long texts are counted whole; null text and text without a letter give ``und`` with score 0; a null lang or a
null doc_id is not learned from; without any learned language every text is ``und``;
ties go to the language first in order; an empty table gives an empty result; repeated
rows are predicted each by itself; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean"
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageRules:
    """``sample_per_language`` bounds the labelled rows whose vectors centroids are fitted
    on (rows are drawn by the hash of their id, so it holds in expectation)."""

    dimensions: int = 8192
    centroids: int = 3
    sample_per_language: int = 500
    rounds: int = 12
    reject_share: float = 0.001


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


# ASCII marks and digits are blanks; bytes of other characters stay.
LETTERS_ONLY = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))


def counts(text: str, dimensions: int) -> np.ndarray:
    """Trigram counts of the whole text by hash cell; runs of blanks count as one."""
    raw = np.frombuffer(f" {text.lower()} ".encode().translate(LETTERS_ONLY), dtype=np.uint8)
    inner = np.ones(len(raw), dtype=bool)
    inner[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    raw = raw[inner].astype(np.uint32)
    codes = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    cells = (codes * np.uint32(2654435761)) >> np.uint32(32 - (dimensions - 1).bit_length())
    return np.bincount(cells, minlength=dimensions)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows."""
    out = np.empty((len(texts), len(idf)), dtype=np.float32)
    for i, text in enumerate(texts):
        out[i] = counts(text, len(idf))
    np.log1p(out, out=out)
    out *= idf
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out


def spherical_means(rows: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Unit centroids; starts are rows far from the starts before them."""
    starts = [0]
    near = rows @ rows[0]
    while len(starts) < min(k, len(rows)):
        starts.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[starts[-1]])
    centres = rows[starts].copy()
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = rows[own == c].mean(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row per centroid
    owner: np.ndarray  # language number of each centroid
    floors: np.ndarray  # lowest accepted cosine per language

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        names, scores, rejected = [], [], []
        for lo in range(0, len(texts), 256):
            part = texts[lo : lo + 256]
            cosines = vectors(part, self.idf) @ self.centroids.T
            best = np.argmax(cosines, axis=1)
            for i, b in enumerate(best.tolist()):
                own = int(self.owner[b])
                c = float(min(1.0, max(0.0, cosines[i, b])))
                names.append(self.languages[own])
                scores.append(c)
                rejected.append(c < self.floors[own])
        return names, scores, rejected


def document_frequencies(learn: DataFrame, dimensions: int) -> tuple[int, np.ndarray]:
    """Learning documents, and in how many of them each cell occurs: one partial row per
    cell and task, summed by Spark; ``dimensions`` numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dimensions, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                df += counts(text, dimensions) > 0
                n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, dimensions)), pa.array(np.r_[n, df])], ["cell", "n"]
        )

    rows = learn.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    df = np.zeros(dimensions + 1)
    for r in rows.collect():
        df[r["cell"] + 1] = r["n"]
    return int(df[0]), df[1:]


def fit(learn: DataFrame, rules: LanguageRules = LanguageRules()) -> LanguageModel | None:
    """The model of the learning documents (doc_id, text, lang, none null); None if there are none."""
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    n, df = document_frequencies(learn, rules.dimensions)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    limit = F.lit(0)
    for lang, size in sizes.items():
        share = min(1 << 20, (rules.sample_per_language << 20) // size + 1)
        limit = F.when(F.col("lang") == lang, F.lit(share)).otherwise(limit)

    def centroids(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("doc_id")
        rows = vectors([t for t in sample["text"] if has_letter(t)], idf)
        if not len(rows):
            return pd.DataFrame({"lang": [], "vector": [], "floor": []})
        centres = spherical_means(rows, rules.centroids, rules.rounds)
        floor = float(np.quantile(np.max(rows @ centres.T, axis=1), rules.reject_share))
        return pd.DataFrame({
            "lang": sample["lang"].iloc[0], "vector": [c.tolist() for c in centres], "floor": floor,
        })

    # A group is one language's sample, whose size the rule bounds.
    found = (
        learn.filter(draw < limit).groupBy("lang")
        .applyInPandas(centroids, "lang string, vector array<float>, floor double").collect()
    )
    languages = sorted({r["lang"] for r in found})
    if not languages:
        return None
    found.sort(key=lambda r: (r["lang"], r["vector"]))
    floors = {r["lang"]: r["floor"] for r in found}
    return LanguageModel(
        languages, idf, np.array([r["vector"] for r in found], dtype=np.float32),
        np.array([languages.index(r["lang"]) for r in found]), np.array([floors[x] for x in languages]),
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, rules: LanguageRules = LanguageRules()) -> DataFrame:
    """Learns from the documents that are not held out and predicts all of them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn(
        "held_out", held_out(F.col("doc_id"))
    )
    learn = rows.filter("not held_out and doc_id is not null and text is not null and lang is not null")
    model = fit(learn.select("doc_id", "text", "lang"), rules)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x centroids x dimensions floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = [i for i, t in enumerate(texts) if known is not None and t is not None and has_letter(t)]
            names, scores, far = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            if at:
                for i, name, score, no in zip(at, *known.predict([texts[i] for i in at]), strict=True):
                    names[i], scores[i], far[i] = name, score, bool(no)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()),
                 pa.array(scores, pa.float64()), pa.array(far, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, SCHEMA)
