"""Whitening against a dense eigensolver."""

from __future__ import annotations

import math

import numpy as np
import pytest

from apptledger.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, component string, whitened int"


def frame(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, "kept", 7) for i, v in enumerate(vectors)], SCHEMA).repartition(parts)


def dense(vectors):
    """(x by row, n, sums, eigenvalues, directions) by the whole covariance matrix."""
    x = [tuple(math.floor(256 * float(c)) for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), float)
    centred = fit - fit.mean(axis=0)
    values, directions = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, len(fit), [sum(c) for c in zip(*set(x), strict=True)], values[::-1], directions[:, ::-1]


def check(rows, vectors, wanted=4):
    x, n, sums, values, directions = dense(vectors)
    assert len(rows) == len(vectors)
    got = np.array([r.whitened for r in sorted(rows, key=lambda r: r.vec_id)])
    real = min(wanted, int((values > 1e-9 * values[0]).sum()))
    assert got.shape[1] == real
    for c in range(real):
        expected = (np.array(x) - np.array(sums) / n) @ directions[:, c] / math.sqrt(values[c])
        assert min(np.abs(got[:, c] - expected).max(), np.abs(got[:, c] + expected).max()) < 1e-8
    for r in rows:
        exact = sum((n * v - s) ** 2 for v, s in zip(x[r.vec_id], sums, strict=True))
        assert r.deviation == (exact if exact < 2**63 else None)


@pytest.mark.parametrize("d", [1, 2, 4, 30, 70])
def test_equals_a_dense_solver(spark, d):
    random = np.random.default_rng(d)
    vectors = (random.standard_normal((200, d)) * np.geomspace(1, 0.3, d)).tolist()
    vectors += [vectors[0]] * 40  # copies do not weigh
    df = frame(spark, vectors)
    model = whitening.fit(df)
    assert model.n == dense(vectors)[1] and model.identity_error < 1e-9
    rows = whitening.whitened(df, model).collect()
    assert rows[0].component == "kept" and rows[0].__fields__.count("whitened") == 1
    check(rows, vectors)
    if d == 70:
        assert model.directions.shape == (70, 4) and (model.residuals <= whitening.TOLERANCE * model.eigenvalues[0]).all()


def test_equal_eigenvalues_and_missing_rank(spark):
    """A flat spectrum has no best directions, but any set must whiten; three points span two dimensions."""
    corners = [[s * (i == j) for j in range(20)] for i in range(20) for s in (1.0, -1.0)]
    model = whitening.fit(frame(spark, corners))
    assert model.identity_error < 1e-9 and np.allclose(model.eigenvalues, 256**2 / 20)
    plane = [[0.0] * 30, [1.0] * 30, [2.0] + [0.0] * 29]
    df = frame(spark, plane)
    check(whitening.whitened(df, whitening.fit(df)).collect(), plane)


def test_rows_that_take_no_part(spark):
    bad = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [1.0, 2.0, 3.0]]
    good = [[0.1, 0.2], [0.5, -0.1], [0.1, 0.2], [-0.4, 0.9]]
    df = frame(spark, good + bad)
    model = whitening.fit(df)
    assert model.n == 3
    check(whitening.whitened(df, model).collect(), good)


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_nothing_to_whiten(spark, vectors):
    df = frame(spark, vectors)
    model = whitening.fit(df)
    rows = whitening.whitened(df, model).collect()
    assert model.eigenvalues.size == 0 and all(r.whitened == [] for r in rows)
    assert len(rows) == (len(vectors) if vectors and vectors[0] else 0)


def test_numbers_beyond_a_long(spark):
    vectors = [[1e300, 1.0], [-1e300, 0.5], [0.25, 0.125], [3e16, 2.0]]
    assert whitening.whole(np.array([1e300, -1e300, 2.0**55, -0.0])).tolist() == [2**63 - 1, -(2**63), 2**63 - 1, 0]
    df = frame(spark, vectors)
    rows = whitening.whitened(df, whitening.fit(df)).collect()
    assert len(rows) == 4 and all(r.deviation is None for r in rows)
    assert all(math.isfinite(w) for r in rows for w in r.whitened)


def test_partial_sums_in_groups(spark, monkeypatch):
    vectors = np.random.default_rng(5).standard_normal((60, 6)).tolist()
    df = frame(spark, vectors)
    one = whitening.fit(df)
    monkeypatch.setattr(whitening, "PARTIALS", 0)
    assert np.allclose(whitening.fit(df).eigenvalues, one.eigenvalues, rtol=1e-13)


def test_the_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = queries.op11_whitening(spark, sf_dir).collect()
    x, n, sums, values, directions = dense([r.embedding for r in table])
    at = {r.vec_id: i for i, r in enumerate(table)}
    assert sorted((r.vec_id, r.component) for r in rows) == sorted((i, c) for i in at for c in (1, 2, 3, 4))
    centred = np.array(x) - np.array(sums) / n
    expected = centred @ directions[:, :4] / np.sqrt(values[:4])
    turned = {c: {r.whitened * expected[at[r.vec_id], c - 1] > 0 for r in rows if r.component == c and abs(r.whitened) > 1e-6}
              for c in (1, 2, 3, 4)}
    assert all(len(v) == 1 for v in turned.values()), "one sign for all rows"
    for r in rows:
        assert abs(abs(r.whitened) - abs(expected[at[r.vec_id], r.component - 1])) < 1e-9
        assert r.n == n and r.deviation == sum((n * v - s) ** 2 for v, s in zip(x[at[r.vec_id]], sums, strict=True))
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-9
