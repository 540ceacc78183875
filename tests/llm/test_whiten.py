"""Whitening against the eigenvectors of the exact covariance."""

import math
import random

import numpy as np
import pytest

from ledgerspark.llm import whiten as W

SCHEMA = "vec_id long, embedding array<double>, x string, label int, component int, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, 3) for i, v in rows], SCHEMA)


def brute(rows, scale=256):
    """(vec_id, n, deviation) of each row that counts, whitened values up to signs, and the shares of the trace."""
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    rank = int((values > 1e-9 * values.max()).sum())
    c = min(4, d, rank)
    values, axes = values[::-1][:c], axes[:, ::-1][:, :c]
    y = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for _, x in kept]) @ axes / np.sqrt(values)
    return [(i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in kept], y, values / (centred**2).sum() * n


def held(rows, df):
    got = df.collect()
    facts, y, shares = brute(rows)
    c = y.shape[1]
    assert len(got) == len(facts) * c
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    signs = None
    for (i, n, deviation), row in sorted(zip(facts, y.tolist(), strict=True), key=lambda x: x[0][0]):
        mine = sorted(by[i], key=lambda r: r.component)[:: len(by[i]) // c]
        assert [r.n for r in mine] == [n] * c and {r.deviation for r in mine} == {deviation}
        signs = signs or [1.0 if r.whitened * w > 0 else -1.0 for r, w in zip(mine, row, strict=True)]
        assert np.allclose([r.whitened for r in mine], np.array(row) * signs, atol=1e-8)
        assert np.allclose([r.explained for r in mine], shares, rtol=1e-8)
        assert all(0 <= r.identity_error < 1e-9 for r in mine)


def test_given_vectors(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    held(rows, W.op12_golub_kahan_whitening(spark, sf))


def test_repeats_nulls_and_other_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(40)]  # copies count once in the fit
    more = [(200, None), (201, [0.1, None, 0.2, 0.3, 0.4]), (202, [0.1, math.nan, 0.0, 0.0, 0.0]), (203, [math.inf] * 5), (204, [])]
    held(rows + more, W.whitened(frame(spark, rows + more)))
    got = W.whitened(frame(spark, [*rows, *more, (205, [1.0, 2.0])])).collect()
    assert {r.vec_id for r in got} == {i for i, _ in rows}
    nameless = W.whitened(frame(spark, [*rows, (None, rows[0][1]), (0, rows[0][1])])).collect()
    assert sum(r.vec_id is None for r in nameless) == 4 and sum(r.vec_id == 0 for r in nameless) == 8


def test_small_rank_and_repeated_eigenvalues(spark):
    line = [(i, [i / 256, 2 * i / 256, 0.0]) for i in range(20)]
    held(line, W.whitened(frame(spark, line)))
    assert W.whitened(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).count() == 0
    assert W.whitened(frame(spark, [])).count() == 0
    axes = np.eye(6) * [9.0, 9.0, 7.0, 5.0, 3.0, 1.0]
    got = W.whitened(frame(spark, [(k, (s * a).tolist()) for k, (s, a) in enumerate((s, a) for s in (1, -1) for a in axes)]), scale=1.0).collect()
    squares = [81, 81, 49, 25, 9, 1]
    assert np.allclose(sorted({round(r.explained, 9) for r in got}), sorted({x / sum(squares) for x in squares[:4]}))
    assert max(r.identity_error for r in got) < 1e-9 and len(got) == 48


def test_large_entries(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) * 2e4 for _ in range(3)]) for i in range(50)]
    held(rows, W.whitened(frame(spark, rows)))
    got = W.whitened(frame(spark, [(i, [v * 1e10 for v in x]) for i, x in rows])).collect()
    assert {r.deviation for r in got} == {None} and max(r.identity_error for r in got) < 1e-6


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_bidiagonal_equals_svd(d):
    x = np.random.default_rng(d).normal(size=(300, d)) * np.linspace(3, 1, d)
    values, axes = W.bidiagonal(lambda w: (x.T @ (x @ w), float((x @ w) @ (x @ w))), d, min(4, d))
    _, s, q = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:4], rtol=1e-12) and np.allclose(np.abs(np.diag(q[:4] @ axes)), 1, atol=1e-10)
