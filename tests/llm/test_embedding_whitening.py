"""Whitening against numpy's eigenvectors of the centred covariance, and exact sums in whole numbers."""

import math

import numpy as np
import pytest

from cindergrid.llm import embedding_whitening as op

INF, NAN = float("inf"), float("nan")


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, n int, whitened string")


def exact(vectors):
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    d = [[n * c - s for c, s in zip(v, sums)] for v in x]
    return n, d, [sum(c * c for c in v) for v in d]


def check(spark, rows, kept, kind="float", components=8):
    """Every value of the ``kept`` rows of ``rows``; vectors of equal values up to rotation are not asked for here."""
    vectors = [np.array(rows[i][1], np.float32 if kind == "float" else float).tolist() for i in kept]
    n, d, deviation = exact(vectors)
    c = np.array(d, float) / n
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    rank = min(components, int((s > 1e-9 * s[0]).sum()))
    want = c @ vt[:rank].T / s[:rank] * np.sqrt(n)
    got = [tuple(r) for r in op.whiten(frame(spark, rows, kind), components=components).collect()]
    assert len(got) == n * rank
    by = {}
    for r in got:
        by.setdefault((r[0], r[1]), []).append(r)
    for k in range(rank):
        mine = []
        for j, i in enumerate(kept):
            same = [r for r in by[(rows[i][0], k + 1)] if r[3] == (deviation[j] if deviation[j] < 2**63 else None)]
            assert same
            mine.append(min(same, key=lambda r: min(abs(r[4] - want[j, k]), abs(r[4] + want[j, k])))[4])
        sign = np.sign(np.dot(mine, want[:, k]))
        assert np.abs(np.array(mine) * sign - want[:, k]).max() < 1e-7
    shares = s[:rank] ** 2 / (s**2).sum()
    assert all(r[2] == n and abs(r[5] / shares[r[1] - 1] - 1) < 1e-9 and 0 <= r[6] < 1e-8 for r in got)
    return got


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(spark, rows, range(len(rows)))


def test_odd_rows(spark):
    r = np.random.default_rng(4)
    rows = [(i, (r.standard_normal(5) * [9, 4, 2, 1, 0.5]).tolist()) for i in range(40)]
    rows += [(40, None), (41, [1.0, None, 2.0, 3.0, 4.0]), (42, [NAN] * 5), (43, [1.0, INF, 0.0, 0.0, 0.0]), (44, []), (45, [1.0, 2.0]), (3, rows[3][1]), (None, [0.5] * 5)]
    check(spark, rows, [*range(40), 46, 47])


def test_fewer_rows_than_dimensions_and_constant_dimensions(spark):
    r = np.random.default_rng(5)
    rows = [(i, [*r.standard_normal(12).tolist(), 7.0, 7.0]) for i in range(5)]
    check(spark, rows, range(5))


def test_large_values_stay_exact(spark):
    r = np.random.default_rng(6)
    rows = [(i, (r.standard_normal(3) * [1e12, 1e9, 1e6]).tolist()) for i in range(12)]
    check(spark, rows, range(12), "double")
    rows = [(i, [1e300 if i == 0 else float(i), float(i * i)]) for i in range(4)]
    got = op.whiten(frame(spark, rows, "double")).collect()
    assert len(got) == 4 and all(r.deviation is None for r in got)


def test_without_variance_and_empty(spark):
    assert op.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    assert op.whiten(frame(spark, [])).count() == 0
    assert op.whiten(frame(spark, [(1, None)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("spectrum", [[5, 5, 5, 2, 2, 1, 1, 1], [9] * 8, [8, 4, 0, 0, 0, 0, 0, 0], list(range(40, 0, -1))])
def test_equal_and_missing_singular_values(spectrum):
    """No copy of a value is missed, whatever space the start vector opens."""
    r = np.random.default_rng(7)
    width = len(spectrum)
    u, v = (np.linalg.qr(r.standard_normal((m, width)))[0] for m in (60, width))
    x = u * np.array(spectrum, float) @ v.T

    def product(g):
        return np.concatenate([x.T @ (x @ g), [np.sum((x @ g) ** 2), np.sum(x * x)]])

    values, vectors, energy, _ = op.bidiagonalise(product, width, 8)
    assert np.allclose(values, sorted(spectrum, reverse=True)[:8], atol=1e-9)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    assert np.allclose(np.linalg.norm(x @ vectors.T, axis=0), values, atol=1e-9) and np.isclose(energy, np.sum(x * x))
