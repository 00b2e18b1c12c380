"""Whitening against an eigendecomposition in plain numpy and exact whole numbers."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from holdfast.llm import whitening as wh

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, count=4):
    whole = [
        (i, tuple(math.floor(256 * c) for c in v)) for i, v, *_ in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in whole:
        away = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        w = (np.array(x) - np.array([s / n for s in sums])) @ vectors[:, :count] / np.sqrt(np.maximum(values[:count], 0))
        out += [(i, k + 1, n, away, w[k], values[k] / values.sum()) for k in range(min(count, len(sums)))]
    return out


def frame(spark, rows):
    full = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], 0) for i, v in rows]
    return spark.createDataFrame(full, SCHEMA), full


def compare(got, want):
    assert Counter(tuple(r)[:4] for r in got) == Counter(w[:4] for w in want)
    for k in {w[1] for w in want}:
        mine = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["whitened"]) for r in got if r["component"] == k)
        for sign in (1, -1):
            ref = sorted((w[0] if w[0] is not None else -1, sign * w[4]) for w in want if w[1] == k)
            if all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-7 for a, b in zip(mine, ref, strict=True)):
                break
        else:
            raise AssertionError(f"component {k}")
        (explained,) = {r["explained"] for r in got if r["component"] == k}
        assert explained == pytest.approx(next(w[5] for w in want if w[1] == k), rel=1e-9)
    assert all(r["identity_error"] < 1e-10 for r in got)


@pytest.mark.parametrize("spread", [1.0, 1e-3])
def test_equals_eigendecomposition(spark, spread):
    draw = random.Random(2)
    rows = [(i, [draw.gauss(j, 1.0 + (3 - j if j < 3 else 0)) * (spread if j == 5 else 1) for j in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(7, rows[7][1]), (None, rows[8][1])]
    rows += [(2000, None), (2001, [1.0, None, 0, 0, 0, 0]), (2002, [float("nan"), 0, 0, 0, 0, 0]), (2003, [0, float("-inf"), 0, 0, 0, 0]),
             (2004, [1.0, 2.0])]
    df, full = frame(spark, rows)
    df = df.selectExpr("*", "'z' AS x", "1 AS n", "2 AS component")
    compare(wh.whiten(df.repartition(4)).collect(), plain(full[:-1]))


def test_large_common_offset_is_centred_first(spark):
    draw = random.Random(9)
    df, full = frame(spark, [(i, [1e4 + draw.gauss(0, 2), -3e4 + draw.gauss(0, 1), draw.gauss(0, 3)]) for i in range(200)])
    compare(wh.whiten(df).collect(), plain(full))


def test_flat_directions_have_no_whitened_value(spark):
    draw = random.Random(4)
    line = [(i, [float(a := draw.randint(-50, 50)), 2.0 * a, 3.0, 0.0]) for i in range(60)]
    got = wh.whiten(frame(spark, line)[0]).collect()
    assert {(r["component"], r["whitened"] is None, r["explained"] > 0) for r in got} == {
        (1, False, True), (2, True, False), (3, True, False), (4, True, False)}
    assert all(r["identity_error"] < 1e-12 for r in got)


def test_single_vector_few_dimensions_and_empty_tables(spark):
    got = wh.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])[0]).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, None, 0.0, 0.0)] * 4
    assert wh.whiten(frame(spark, [])[0]).count() == 0
    assert wh.whiten(frame(spark, [(1, None), (2, [])])[0]).count() == 0


def test_deviations_are_exact():
    x = np.array([[3, -5], [2**31, 7]])
    for n, sums in ((5, (10, -3)), (10**9, (10**12 + 1, 7)), (10**12, (1, 2))):
        model = wh.Whitening(n, sums, np.eye(2), np.ones(2))
        want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
        assert wh.deviations(x, model) == [v if v < 2**63 else None for v in want]


def test_entries_floor_and_sums_are_exact(spark):
    df, _ = frame(spark, [(1, [-0.001, 0.999, 1e30])])
    assert wh.scaled(df).first()["x"] == [-1, 255, 2**63 - 1]
    big = np.array([[2**62, 1], [2**62, 2], [2**62, 3]])
    assert wh.exact_sums(big) == [3 * 2**62, 6]


def test_triangular_solve_and_shift():
    draw = np.random.default_rng(0)
    r = np.triu(draw.normal(size=(5, 5))) + 3 * np.eye(5)
    x = draw.normal(size=(40, 5))
    assert np.allclose(wh.solved(x, r) @ r, x, atol=1e-12)
    flat = np.ones((3, 3))
    f = wh.shifted_factor(flat, 10, always=False)
    assert np.allclose(f.T @ f, flat, atol=1e-9) and np.allclose(f, np.triu(f))
