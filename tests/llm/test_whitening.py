"""Whitening against NumPy's eigenvectors, and its solver on matrices that are hard to divide."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry_module
from spectraloom.llm import whitening as w


def spread(seed, values):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return w.symmetric(q @ np.diag(values) @ q.T)


HARD = {
    "equal": np.ones(12), "zero": np.zeros(5), "two": np.r_[np.ones(10), np.zeros(10)], "steep": 10.0 ** np.arange(0, -20, -0.5),
    "near": np.r_[np.ones(8), 1 + 1e-9 * np.arange(8)], "signs": np.linspace(-3, 4, 17), "one": np.array([5.0]),
}


@pytest.mark.parametrize("name", HARD)
def test_hard_spectra(name):
    a = spread(3, HARD[name])
    values, vectors = w.spectrum(a)
    scale = max(np.linalg.norm(a), 1e-300)
    np.testing.assert_allclose(values, np.sort(HARD[name])[::-1], atol=1e-14 * scale * len(a))
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-14
    assert np.abs(a @ vectors - vectors * values).max() < 1e-14 * scale


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.lists(st.sampled_from([0.0, 1.0, 1.0 + 1e-12, 2.5, 100.0, 1e-7, -3.0]), min_size=1, max_size=14))
def test_spectra_with_ties(seed, values):
    a = spread(seed, np.array(values))
    found, vectors = w.spectrum(a)
    np.testing.assert_allclose(found, np.sort(values)[::-1], atol=1e-12 * max(1, np.abs(values).max()))
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12))
def test_polar_factor(seed, size):
    a = w.symmetric(np.random.default_rng(seed).normal(size=(size, size)))
    u = w.polar_factor(a)
    values, vectors = np.linalg.eigh(a)
    np.testing.assert_allclose(u, vectors @ np.diag(np.sign(values)) @ vectors.T, atol=1e-9 / np.abs(values).min())


def by_hand(vectors):
    x = np.floor(1024.0 * np.asarray(vectors, float)).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:8]
    deviation = [sum((int(n) * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return n, deviation, centred @ basis[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_query_equals_numpy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids = [r.vec_id for r in rows]
    n, deviation, whitened, explained = by_hand([r.embedding for r in rows])
    df = entry_module.queries()["op12_whitening"](spark, sf_dir)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = df.orderBy("component", "vec_id").collect()
    assert [(r.component, r.vec_id) for r in found] == [(k, i) for k in range(1, 9) for i in ids]
    assert {r.n for r in found} == {n} and [r.deviation for r in found] == deviation * 8
    values = np.array([r.whitened for r in found]).reshape(8, n).T
    signs = np.sign((values * whitened).sum(axis=0))
    np.testing.assert_allclose(values * signs, whitened, atol=1e-9)
    np.testing.assert_allclose([r.explained for r in found[::n]], explained, rtol=1e-10)
    error = {r.identity_error for r in found}
    assert len(error) == 1 and error.pop() < 1e-10
    np.testing.assert_allclose(values.T @ values / n, np.eye(8), atol=1e-9)


def frame(spark, vectors, schema="vec_id long, embedding array<double>, id int, vector string"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors)], schema)


def whitened(spark, vectors, **options):
    numbers = w.whole_numbers(frame(spark, vectors))
    model = w.learn_whitening(numbers, **options)
    return w.whiten(numbers, model).collect(), model


def test_odd_vectors_take_no_part(spark):
    good = np.random.default_rng(2).normal(size=(40, 5)).tolist()
    odd = [None, [], [1.0], [None] * 5, [math.nan] * 5, [math.inf, 0.0, 0.0, 0.0, 0.0], [0.0] * 4]
    found, model = whitened(spark, good + odd)
    assert model.rows == 40 and {r.id for r in found} == set(range(40)) and {r.component for r in found} == {1, 2, 3, 4, 5}
    wanted = by_hand(good)[2]
    values = np.array([[r.whitened for r in found if r.id == i] for i in range(40)])
    np.testing.assert_allclose(np.abs(values), np.abs(wanted), atol=1e-9)


def test_repeated_rows_and_no_variance(spark):
    found, model = whitened(spark, [[1.0, 2.0, 3.0]] * 6)
    assert found == [] and model.rows == 6
    line = [[float(i), 2.0 * i, 5.0] for i in (0, 0, 1, 3)]
    found, model = whitened(spark, line)
    assert {r.component for r in found} == {1} and found[0].identity_error < 1e-12 and found[0].explained == pytest.approx(1)
    assert found[0].whitened == found[1].whitened
    assert [r.deviation for r in found] == by_hand(line)[1]


def test_empty_table(spark):
    found, model = whitened(spark, [])
    assert (found, model) == ([], None)
    assert whitened(spark, [None, []])[0] == []


def test_deviations_beyond_a_long(spark):
    """Exact in decimals where they fit a long; NULL where they do not."""
    found, _ = whitened(spark, [[2.0**21], [2.0**21], [-(2.0**21)], [0.0]])
    n, deviation, *_ = by_hand([[2.0**21], [2.0**21], [-(2.0**21)], [0.0]])
    assert max(deviation) > 2**63 > min(deviation)
    assert [r.deviation for r in sorted(found, key=lambda r: r.id)] == [d if d < 2**63 else None for d in deviation]
