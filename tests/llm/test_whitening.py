import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import whitening as wh

KIND = "vec_id long, embedding array<float>"


def brute(rows, k=4):
    """(key, vector) rows -> per remaining row: deviation, whitened up to signs, by numpy's own eigenvectors."""
    good = [(key, [math.floor(256 * float(np.float32(c))) for c in v]) for key, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), object)
    n, total = len(fit), fit.sum(axis=0)
    mean = np.array([s / n for s in total])
    centred = fit.astype(float) - mean
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, values, values / np.trace(cov), [(key, sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)), (np.array(x, float) - mean) @ vectors / np.sqrt(values)) for key, x in good]


def sample(n=300, d=12, seed=0):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    data = rng.standard_normal((n, d)) * np.linspace(3, 0.3, d) @ turn
    return [(i, [float(c) for c in row]) for i, row in enumerate(data)]


def test_equals_numpy(spark):
    rows = sample() + [(500, None), (501, [1.0] * 11 + [None]), (502, [float("nan")] * 12), (503, [float("inf")] + [0.0] * 11), (None, [0.5] * 12)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # one vector holds two fifths of all rows and weighs once
    n, values, explained, want = brute(rows)
    got = wh.whitening(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == 4 * len(want)
    by_key = {}
    for r in got:
        by_key.setdefault(r.vec_id, {})[r.component] = r
    signs = np.sign([by_key[0][c].whitened for c in range(1, 5)]) * np.sign(want[0][2])
    for key, deviation, white in want:
        own = by_key[key]
        assert [own[c].deviation for c in range(1, 5)] == [deviation] * 4
        assert np.allclose([own[c].whitened for c in range(1, 5)], white * signs, atol=1e-9)
        assert np.allclose([own[c].explained for c in range(1, 5)], explained, rtol=1e-10)
        assert own[1].n == n and own[1].identity_error < 1e-9


def test_odd_tables(spark):
    assert wh.whitening(spark.createDataFrame([], KIND)).collect() == []
    assert wh.whitening(spark.createDataFrame([(1, None), (2, [])], KIND)).collect() == []
    assert wh.whitening(spark.createDataFrame([(1, [0.5, 0.5])] * 5, KIND)).collect() == []  # no variance, no component
    line = wh.whitening(spark.createDataFrame([(i, [i / 8, i / 4, 1.0]) for i in range(9)] + [(99, [1.0])], KIND)).collect()
    assert {r.component for r in line} == {1} and len(line) == 9 and line[0].explained == pytest.approx(1)


def test_clashing_columns_and_other_names(spark):
    rows = [(i, v, 1, 2, "x") for i, v in sample(40, 5)]
    docs = spark.createDataFrame(rows, "key long, v array<double>, x int, n int, component string")
    found = wh.whitening(docs, vector="v", key="key", components=2)
    assert found.columns[0] == "key" and found.count() == 80


def test_deviations_beyond_a_long_are_null():
    x = np.array([[1 << 40, 0], [3, 4]], np.int64)
    assert wh._deviations(x, 3, np.array([0, 0], object)) == [None, 225]
    assert wh._deviations(x[1:], 3, np.array([0, 0], object)) == [225]


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_inertia_counts_eigenvalues(d):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, d))
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    for shift in np.concatenate([rng.uniform(values.min() - 1, values.max() + 1, 20), [0.0]]):
        assert wh.inertia(a, shift) == (values > shift).sum()
    assert wh.inertia(np.zeros((d, d)), 0.0) == 0
    assert wh.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


@pytest.mark.parametrize("kind", ["spread", "equal", "pairs", "low rank", "close"])
def test_feast_finds_all_of_an_interval(kind):
    rng = np.random.default_rng(4)
    d = 48
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = {"spread": np.arange(1.0, d + 1), "equal": np.full(d, 3.0), "pairs": np.repeat(np.arange(1.0, d // 2 + 1), 2), "low rank": np.r_[5.0, 2.0, np.zeros(d - 2)], "close": 1 + 1e-9 * np.arange(d)}[kind]
    matrix = q * values @ q.T
    matrix = (matrix + matrix.T) / 2
    got, vectors = wh.leading(matrix, 4)
    want = np.sort(values)[::-1][: 2 if kind == "low rank" else 4]
    assert np.allclose(got, want, rtol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-12)
    assert np.abs(matrix @ vectors - vectors * got).max() < 1e-12 * want[0]


def test_intervals_hold_what_inertia_counts():
    rng = np.random.default_rng(9)
    a = rng.standard_normal((30, 90))
    a = a @ a.T
    values = np.linalg.eigvalsh(a)
    for low, high, inside in wh.intervals(a, 30, most=3):
        assert inside == ((values > low) & (values < high)).sum() <= 3
        assert len(wh.feast(a, low, high, inside)[0]) == inside


def test_array_of_doubles_and_key_of_text(spark):
    docs = spark.createDataFrame([(str(i), v) for i, v in sample(50, 6)], "vec_id string, embedding array<double>").withColumn("label", F.lit(1))
    assert {r.component for r in wh.whitening(docs).collect()} == {1, 2, 3, 4}
