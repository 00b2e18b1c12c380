"""Embedding whitening by shifted Cholesky QR.

Vectors are scaled to whole numbers, each distinct vector is fitted once.  Every pass adds
up a Gram matrix over the centred rows in the executors; its Cholesky factor R turns the
rows into better conditioned ones by a triangular solve, and the product of the factors is
the R of the whole table, whose singular vectors and values whiten it.  The first factor is
shifted, so that it exists whatever the condition; a later one is where plain Cholesky fails.

Only sums of the size of the dimension (d numbers, d x d matrices) reach the driver, and
each is added up in the executors first.  Centring comes before any multiplication.

Defined results: a null vector, or one with a null or non-finite entry, is left out; so are
vectors of another length than the commonest (of equally common ones the longest).  Entries
beyond a whole number of 64 bits take its end.  A repeated row gives repeated rows.  A null
vec_id stays.  Directions whose variance is below 1e-12 of the largest are not whitened
(whitened is null); explained is 0 there.  A deviation beyond 64 bits is null.  An empty
table gives an empty table.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from holdfast.llm import shared as sh

SCALE = 256
PASSES = 3
FLAT = 1e-12
FAN_IN = 256  # tasks whose sums are added first
LEAST = 1e-30  # under the variance of any whole numbers that vary
BLOCK_ROWS = 4096

RESULT = pa.schema(
    [
        ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
    ]
)


@dataclass(frozen=True)
class Whitening:
    """What the fit gives: rows, exact sums, unit components by falling variance, all variances."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # one row each
    variances: np.ndarray

    @property
    def steep(self) -> np.ndarray:
        """Which directions vary."""
        return self.variances > max(FLAT * self.variances.max(initial=0), LEAST)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray, count: int) -> np.ndarray:
        """Whitened values of whole-number rows, not a number where a direction is flat."""
        scale = np.where(self.steep, np.sqrt(self.variances), np.nan)[:count]
        return (x - self.mean) @ self.components[:count].T / scale


def scaled(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is whole and finite, with ``x``, the vector in whole numbers."""
    entries = F.col(vector)
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    kept = rows.filter(entries.isNotNull() & fine)
    sizes = kept.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size"))
    common = sizes.first()
    width = common["size"] if common else 0
    return kept.filter(F.size(vector) == width).withColumn(
        "x", F.transform(entries, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    )


def _blocks(batches: Iterable[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows with their vectors as a matrix of whole numbers."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            lists = part.column(column)
            yield part, lists.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums per column as Python's whole numbers."""
    if len(x) * (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) < 2**62:
        return [int(s) for s in x.sum(axis=0)]
    return [sum(int(v) for v in column) for column in x.T]


def _totals(fit: DataFrame) -> tuple[int, tuple[int, ...], float]:
    """Rows, exact sums per dimension and the largest entry's size."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, largest, sums = 0, 0.0, None
        for _, x in _blocks(batches):
            n += len(x)
            largest = max(largest, float(np.abs(x.astype(np.float64)).max(initial=0)))
            sums = [a + b for a, b in zip(sums or [0] * x.shape[1], exact_sums(x), strict=True)]
        if sums is not None:
            yield pa.record_batch(
                {"n": pa.array([n] * len(sums)), "at": pa.array(range(len(sums)), pa.int32()),
                 "part_sum": pa.array([str(s) for s in sums]), "largest": pa.array([largest] * len(sums))}
            )

    parts = fit.select("x").mapInArrow(partial, "n long, at int, part_sum string, largest double")
    rows = parts.groupBy("at").agg(
        F.sum("n").alias("n"), F.sum(F.col("part_sum").cast("decimal(38,0)")).cast("string").alias("total"),
        F.max("largest").alias("largest"),
    ).orderBy("at").collect()
    if not rows:
        return 0, (), 0.0
    return rows[0]["n"], tuple(int(r["total"]) for r in rows), max(r["largest"] for r in rows)


def _added(fit: DataFrame, use: Callable[[np.ndarray], np.ndarray], rows: int, columns: int) -> np.ndarray:
    """The sum of ``use(block)``, a small matrix, over all blocks of the fit list.

    Tasks give one row per matrix row; these are added in the executors, in the order of
    their tasks, a bounded number at a time.
    """

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((rows, columns))
        for _, x in _blocks(batches):
            total += use(x)
        task = TaskContext.get().partitionId()
        yield pa.record_batch(
            {"line": pa.array(range(rows), pa.int32()), "task": pa.array([task] * rows, pa.int32()),
             "sums": pa.array(list(total), pa.list_(pa.float64()))}
        )

    def summed(lines: pd.DataFrame) -> pd.DataFrame:
        lines = lines.sort_values("task")
        return pd.DataFrame(
            {"line": lines["line"].iloc[:1], "task": lines["task"].iloc[:1] // FAN_IN,
             "sums": [np.sum(np.stack(lines["sums"].to_numpy()), axis=0)]}
        )

    kind = "line int, task int, sums array<double>"
    parts = fit.select("x").mapInArrow(partial, kind)
    some = parts.groupBy("line", F.floor(F.col("task") / FAN_IN)).applyInPandas(summed, kind)
    out = np.zeros((rows, columns))
    for row in some.groupBy("line").applyInPandas(summed, kind).collect():
        out[row["line"]] = row["sums"]
    return out


def solved(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``x`` times the inverse of the upper triangular ``r``, column by column."""
    out = np.empty_like(x)
    for j in range(r.shape[0]):
        out[:, j] = (x[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def shifted_factor(gram: np.ndarray, n: int, always: bool) -> np.ndarray:
    """The upper Cholesky factor; with ``always``, or where the plain one fails, of the shifted matrix."""
    d = len(gram)
    if not always:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * max(np.linalg.norm(gram, 2), 1e-200)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 16


def fit_whitening(fit: DataFrame) -> Whitening | None:
    """Fit on all rows of ``x``, a written table; None if there is none."""
    n, sums, largest = _totals(fit)
    if not n:
        return None
    d = len(sums)
    mean = np.array([s / n for s in sums])
    unit = max(largest, 1.0)  # rows are scaled down, so that squares stay within doubles
    factors: list[np.ndarray] = []
    whole = np.eye(d)
    for k in range(PASSES):
        known = list(factors)

        def gram(x: np.ndarray, known: list[np.ndarray] = known) -> np.ndarray:
            q = (x - mean) / unit
            for r in known:
                q = solved(q, r)
            return q.T @ q

        factor = shifted_factor(_added(fit, gram, d, d), n, always=k == 0)
        factors.append(factor)
        whole = factor @ whole
    _, values, components = np.linalg.svd(whole)
    largest_at = np.abs(components).argmax(axis=1)
    signs = np.sign(components[np.arange(d), largest_at])
    return Whitening(n, sums, components * signs[:, None], (values * unit) ** 2 / n)


def identity_error(fit: DataFrame, model: Whitening, count: int) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity, over directions that vary."""
    steep = np.flatnonzero(model.steep[:count])
    if not len(steep):
        return 0.0

    def first(x: np.ndarray) -> np.ndarray:
        return model.project(x, count)[:, steep].sum(axis=0, keepdims=True)

    mean = _added(fit, first, 1, len(steep)) / model.n

    def second(x: np.ndarray) -> np.ndarray:
        w = model.project(x, count)[:, steep] - mean
        return w.T @ w

    return float(np.abs(_added(fit, second, len(steep), len(steep)) / model.n - np.eye(len(steep))).max())


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over dimensions of (n * x - sum) squared, exact; None beyond 64 bits."""
    n, sums = model.n, np.array(model.sums, dtype=object)
    most = n * (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) + max(abs(s) for s in model.sums)
    if most * most * x.shape[1] < 2**63:
        away = x * n - sums.astype(np.int64)
        return (away * away).sum(axis=1).tolist()
    away = x.astype(object) * n - sums
    return [v if v < 2**63 else None for v in (away * away).sum(axis=1)]


def whiten(rows: DataFrame, vector: str = "embedding", count: int = 4) -> DataFrame:
    """Every row's whitened values along the first ``count`` components, one row for each."""
    kept = scaled(rows, vector).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    fit = sh.written(kept.select("x").distinct(), "whitening")
    model = fit_whitening(fit)
    kind = from_arrow_schema(RESULT)
    if model is None or not model.sums:
        return rows.sparkSession.createDataFrame([], kind)
    count = min(count, len(model.sums))
    error = identity_error(fit, model, count)
    explained = np.where(model.steep, model.variances, 0) / max(model.variances.sum(), LEAST)

    def projected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1):
            ids = part.column(0).to_pylist()
            values = model.project(x, count)
            columns = [
                [i for i in ids for _ in range(count)], list(range(1, count + 1)) * len(ids),
                [model.n] * (count * len(ids)), [v for v in deviations(x, model) for _ in range(count)],
                pa.array(values.ravel(), pa.float64(), from_pandas=True), list(explained[:count]) * len(ids),
                [error] * (count * len(ids)),
            ]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, RESULT, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=RESULT)

    return kept.mapInArrow(projected, kind)
