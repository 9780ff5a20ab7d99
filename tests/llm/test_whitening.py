"""Whitening against numpy's eigenvalues and Python's whole numbers."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadgauge.llm import queries
from loadgauge.llm.whitening import exact_gram, inertia, leading_pairs, whiten


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))[0]
    m = (q * np.asarray(values, float)) @ q.T
    return (m + m.T) / 2


SPECTRA = {
    "spread": [900.0, 500, 300, 200, 90, 30, 20, 10, 5, 1, 0.5, 0.1],
    "equal": [7.0] * 12,
    "clusters": [9.0, 9, 9, 5, 5, 1, 1, 1, 1, 1, 0.1, 0],
    "close": [1000 - i * 1e-9 for i in range(12)],
    "low rank": [50.0, 2, 1] + [0.0] * 9,
    "zero": [0.0] * 4,
    "one": [3.0],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_leading_pairs(name):
    m = symmetric(SPECTRA[name])
    want = [v for v in SPECTRA[name][:8] if v > 0]
    values, vectors = leading_pairs(m)
    assert len(values) == len(want) and np.allclose(values, want, rtol=1e-12, atol=1e-12)
    scale = max(SPECTRA[name])
    assert np.abs(m @ vectors - vectors * values).max(initial=0) <= 1e-13 * max(scale, 1) * 8
    assert np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-13)


def test_inertia_counts():
    r = np.random.default_rng(5)
    for n in (1, 2, 5, 20):
        m = r.standard_normal((n, n))
        m = m + m.T
        values = np.linalg.eigvalsh(m)
        for shift in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1]:
            assert inertia(m, shift) == (values > shift).sum()
    assert inertia(np.array([[0.0, 1], [1, 0]]), 0.0) == 1 and inertia(np.zeros((3, 3)), 0.0) == 0


@pytest.mark.parametrize("top", [3000, 1 << 30, 1 << 46])
def test_gram_is_exact(top):
    x = np.random.default_rng(1).integers(-top, top, (300, 5))
    assert (exact_gram(x) == x.astype(object).T @ x.astype(object)).all()


def brute(rows):
    """[(id, deviation, centred vector)], covariance"""
    fit = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in fit]
    n, sums = len(xs), [sum(col) for col in zip(*xs, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in xs])
    deviations = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in xs]
    return [i for i, _ in fit], deviations, centred, centred.T @ centred / n


def hold(found, rows, most=8):
    ids, deviations, centred, covariance = brute(rows)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(most, int((values > 1e-9 * values[0]).sum()))
    assert Counter((r.vec_id, r.component, r.deviation) for r in found) == Counter(
        (i, c, d) for i, d in zip(ids, deviations, strict=True) for c in range(1, count + 1)
    )
    for c in range(1, count + 1):
        want = centred @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        key = lambda p: (p[0] is None, p[0] or 0, p[1])
        mine = sorted(((r.vec_id, r.deviation, r.whitened) for r in found if r.component == c), key=key)
        theirs = sorted(zip(ids, deviations, want, strict=True), key=key)
        a, b = np.array([m[2] for m in mine]), np.array([t[2] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert all(math.isclose(r.explained, values[c - 1] / values.sum(), rel_tol=1e-9) for r in found if r.component == c)
    assert len({(r.n, r.identity_error) for r in found}) == 1 and found[0].identity_error < 1e-9 and found[0].n == len(ids)


SCHEMA = "vec_id long, embedding array<float>"


def test_awkward_rows(spark):
    r = random.Random(2)
    vector = lambda: [float(np.float32(r.gauss(0, s))) for s in (3, 2, 1, 0.5, 0.2)]
    rows = [(i, vector()) for i in range(60)] + [(7, vector()), (None, vector()), (None, vector())]
    rows += [(100, None), (101, []), (102, [1.0, None, 1.0]), (103, [math.nan] * 5), (104, [1.0, math.inf, 1.0, 1.0, 1.0])]
    other = [(105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0, 0.0, 0.0])]
    names = ["component", "N", "place", "__whitened", "deviation"]
    table = spark.createDataFrame(rows + other, SCHEMA).withColumns({name: F.lit("x") for name in names})
    white = whiten(table)
    assert set(white.columns) == {"vec_id", "place", "__whitened", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    hold(white.collect(), rows)
    again = whiten(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)).collect()
    assert {(x.vec_id, x.component, x.deviation, x.whitened) for x in again} == {(x.vec_id, x.component, x.deviation, x.whitened) for x in white.collect()}


def test_deviations_beyond_a_long_are_exact(spark):
    rows = [(i, [1e9 * (-1) ** i, float(i)]) for i in range(40)]
    hold(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows)


def test_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    hold(queries.op12_whitening(spark, sf_dir).collect(), rows)
