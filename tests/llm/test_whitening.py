"""Whitening against numpy on the whole matrix, and the eigenvalue steps one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcgraph.llm import whitening

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT"


def run(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("clash")).withColumn("component", F.lit(0))
    return whitening.whiten(frame).collect()


def test_against_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 12)) * np.linspace(2, 0.1, 12) + 0.7
    rows = [(i, v.astype("float32").tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1], None) for i in range(200)] + [(None, rows[1][1], 0)]
    bad = [(2000, None, 1), (2001, [float("nan")] * 12, 1), (2002, [None] + [1.0] * 11, 0),
           (2003, [float("inf")] + [0.0] * 11, 0), (2004, [], 0)]
    got = run(spark, rows + bad)
    assert len(got) == 4 * len(rows)
    x = {r[0]: [math.floor(256 * c) for c in r[1]] for r in rows}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=float)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    by = {c: {} for c in (1, 2, 3, 4)}
    for r in got:
        by[r.component].setdefault(r.vec_id, r)
        assert r.n == n and r.deviation == sum((n * v - s) ** 2 for v, s in zip(x[r.vec_id], sums))
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10 and r.identity_error < 1e-9
    ids = [r[0] for r in rows]
    for c in (1, 2, 3, 4):
        want = (np.array([x[i] for i in ids]) - fit.mean(0)) @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        have = np.array([by[c][i].whitened for i in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9


def test_awkward_tables(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, 0)]) == []
    got = run(spark, [(i, [0.5, 0.25], 0) for i in range(3)])
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {
        (i, c, 1, 0, None, None, None) for i in range(3) for c in (1, 2)}
    # fewer directions with variance than components
    line = run(spark, [(i, [float(i), 2.0 * i, 0.0, 0.0, 0.0], 0) for i in range(9)])
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in line)
    assert {round(r.explained, 9) for r in line if r.component == 1} == {1.0}
    # every length is a table of its own; minus zero is zero; huge entries stay in range
    mixed = run(spark, [(i, [float(i % 7), float(i // 7)], 0) for i in range(49)]
                + [(100 + i, [1e30 * i, -0.0, 1.0], 0) for i in range(4)])
    assert {(r.n, r.vec_id >= 100) for r in mixed} == {(49, False), (2, True)}
    assert all(r.deviation is None for r in mixed if r.vec_id >= 100) and len(mixed) == 49 * 2 + 4 * 3


@pytest.mark.parametrize("seed", range(6))
def test_leading_components(seed):
    rng = np.random.default_rng(seed)
    d = [2, 3, 8, 40, 64, 64][seed]
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    values = np.sort(rng.random(d))[::-1] * 10.0 ** rng.integers(-8, 8)
    if seed % 2:
        values[:3] = values[0]  # a cluster of equal values
    if seed == 4:
        values[2:] = 0
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, vectors = whitening.leading_components(a, 4)
    k = min(4, d)
    assert np.allclose(got, values[:k], rtol=1e-12, atol=1e-13 * values[0])
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * got).max() < 1e-12 * values[0]


def test_special_matrices():
    for a in (np.diag([3.0, 1.0, 2.0, 2.0, 0.0]), np.eye(6), np.zeros((3, 3)), np.array([[2.0]]), np.ones((5, 5))):
        got, vectors = whitening.leading_components(a, 4)
        want = np.sort(np.linalg.eigvalsh(a))[::-1][:4]
        assert np.allclose(got, want, atol=1e-14) and np.abs(a @ vectors - vectors * got).max() < 1e-13
        assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-13


def test_sturm_counts():
    rng = np.random.default_rng(1)
    diagonal, off = rng.normal(size=20), rng.normal(size=19)
    off[5] = 0
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    for t in np.linspace(-4, 4, 60):
        assert whitening.sturm_count(diagonal, off, t) == (values < t).sum()


def test_parts_merge_like_the_whole():
    y = np.random.default_rng(0).normal(size=(50, 3)) + 1e6
    parts = [(len(p), p.mean(0), (p - p.mean(0)).T @ (p - p.mean(0))) for p in (y[:7], y[7:20], y[20:])]
    n, mean, products = whitening.merged(whitening.merged(parts[0], parts[1]), parts[2])
    assert n == 50 and np.allclose(mean, y.mean(0)) and np.allclose(products / n, np.cov(y.T, bias=True), atol=1e-6)
