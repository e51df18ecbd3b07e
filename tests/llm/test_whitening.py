"""Whitened rows against a dense eigenvalue decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def by_brute_force(rows, width):
    x = {i: [int(np.floor(256 * np.float64(np.float32(c)))) for c in v] for i, v in rows}
    fitted = np.unique([v + [0] * (width - len(v)) for v in x.values()], axis=0)
    n, sums = len(fitted), fitted.sum(axis=0)
    away = fitted - sums / n
    values, vectors = np.linalg.eigh(away.T @ away / n)
    return x, n, sums, values[::-1], vectors[:, ::-1]


def check(spark, rows, usable, width):
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    x, n, sums, values, vectors = by_brute_force(usable, width)
    m = int((values[:4] > 1e-9 * values.sum()).sum())
    assert sorted((r.vec_id, r.component) for r in got) == sorted(
        (i, c + 1) for i, _ in usable for c in range(m)
    )
    white = {(r.vec_id, r.component): r for r in got}
    for i, _ in usable:
        v = np.array(x[i] + [0] * (width - len(x[i])), dtype=object)
        assert white[i, 1].deviation == sum((n * v - sums) ** 2)
        for c in range(m):
            expected = (v.astype(float) - sums / n) @ vectors[:, c] / np.sqrt(values[c])
            assert abs(white[i, c + 1].whitened) == pytest.approx(abs(expected), abs=1e-9)
            assert white[i, c + 1].explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
            assert white[i, c + 1].n == n and white[i, c + 1].identity_error < 1e-9


def test_against_dense(spark):
    rng = np.random.default_rng(0)
    scales = np.array([3, 2, 1.5, 1, 0.5, 0.2, 0.1])
    rows = [(i, (rng.standard_normal(7) * scales + 1).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(100)]  # repeated vectors count once
    odd = [(-1, None), (-2, [1.0, None]), (-3, [float("nan")] * 7), (-4, [float("inf")] * 7)]
    check(spark, rows + odd, rows, 7)
    short = [(500, [1.0, 2.0]), (501, [])]  # filled with zeros
    check(spark, rows + short, rows + short, 7)
    check(spark, rows[:3], rows[:3], 7)  # fewer vectors than components


def test_equal_eigenvalues_are_all_found(spark):
    rows = [(i, (np.eye(6)[i % 6] * (-1) ** (i // 6)).tolist()) for i in range(12)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 48 and all(r.identity_error < 1e-12 for r in got)
    assert all(r.explained == pytest.approx(1 / 6) for r in got)


def test_early_end_finds_the_same():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((500, 40)) * 0.5 ** np.arange(40)
    passes = []

    def gram(p):
        passes.append(1)
        return a.T @ (a @ p)

    values, vectors = whitening.bidiagonalise(gram, 40, float((a * a).sum()), 4)
    _, expected, rows = np.linalg.svd(a)
    assert np.allclose(values, expected[:4], rtol=1e-12) and len(passes) < 30
    assert np.allclose(np.abs(np.sum(vectors * rows[:4].T, axis=0)), 1, atol=1e-12)


def test_odd_tables(spark):
    rows = [(1, [1.0, 2.0]), (None, [3.0, 1.0]), (1, [1.0, 2.0]), (2, [3e38, -3e38])]
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.select("*", *(F.lit(7).alias(c) for c in "x entry value n component".split()))
    for vectors in (df, wide):
        got = whitening.whiten(vectors).collect()
        # Sums of squares beyond 64 bits are null.
        assert {r.vec_id for r in got} == {1, 2, None} and all(r.deviation is None for r in got)
        assert all(np.isfinite(r.whitened) for r in got)
    for nothing in ("vec_id = 9", "vec_id = 1"):  # no row, and no variance
        assert whitening.whiten(df.where(nothing)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], SCHEMA)).count() == 0
