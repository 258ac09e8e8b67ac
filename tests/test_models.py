"""Components, regressions and corrections against NumPy, with missing values, copies, outliers and many batches."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectraloom.functions.distributions import chi_square_quantile, cube_root_quantile
from spectraloom.operators import baseline, components, correction, regression, smoothing
from spectraloom.operators.spectra import from_array
from spectraloom.plans.moments import BLOCK, Moments, merged, moments

AXIS = [400 + 2.0 * i for i in range(12)]


def random_rows(n=90, bands=12, seed=1, offset=1000.0):
    """Values on a large offset: sums of squares about zero would lose the small differences."""
    random = np.random.default_rng(seed)
    return offset + random.normal(size=(n, bands)) @ random.normal(size=(bands, bands))


def frame(spark, rows, axis=None, more=None, partitions=5):
    axis = AXIS if axis is None else axis
    values = [None if r is None else [None if v is None else float(v) for v in r] for r in rows]
    data = [(i, v, *([None if more[i] is None else float(more[i])] if more is not None else [])) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "k int, spectrum array<double>" + (", y double" if more is not None else ""))
    return from_array(df.repartition(partitions), axis)


def column(df, name):
    return [r[name] for r in df.orderBy("k").collect()]


# ---- moments ------------------------------------------------------------------------------------------------------


def test_moments_by_fold_and_block(spark):
    rows = random_rows(60, BLOCK + 30)
    df = frame(spark, [*rows, None, [float("nan")] * (BLOCK + 30), [None] * (BLOCK + 30), [float("inf")] * (BLOCK + 30)], range(BLOCK + 30)).df
    found = moments(df, F.col("spectrum"), BLOCK + 30, F.when(F.col("k") != 5, F.col("k") % 3))
    assert sorted(found) == [0, 1, 2]
    for fold, m in found.items():
        own = rows[[i for i in range(60) if i % 3 == fold and i != 5]]
        assert m.n == len(own)
        np.testing.assert_allclose(m.mean, own.mean(axis=0), rtol=1e-13)
        np.testing.assert_allclose(m.covariance, np.cov(own.T), rtol=1e-9, atol=1e-9)


def test_no_moments_of_nothing(spark):
    assert moments(frame(spark, []).df, F.col("spectrum"), 12) == {}
    with pytest.raises(ValueError, match="two spectra"):
        components.fit_components(frame(spark, [None]), 2)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.lists(st.integers(0, 7), min_size=1, max_size=6))
def test_merging_equals_one_pass(seed, sizes):
    random = np.random.default_rng(seed)
    parts = [1e6 + random.normal(size=(n, 3)) for n in sizes]
    every = np.vstack(parts)
    found = merged((Moments.of(p) for p in parts if len(p)), 3)
    assert found.n == len(every)
    if len(every):
        np.testing.assert_allclose(found.scatter, Moments.of(every).scatter, rtol=1e-7, atol=1e-8)


# ---- components ---------------------------------------------------------------------------------------------------


def test_components_equal_numpy(spark):
    rows = random_rows()
    model = components.fit_components(frame(spark, rows), 4)
    values, vectors = np.linalg.eigh(np.cov(rows.T))
    np.testing.assert_allclose(model.variances, values[::-1][:4], rtol=1e-10)
    wanted = components.upright(vectors[:, ::-1][:, :4].T)
    np.testing.assert_allclose(model.loadings, wanted, atol=1e-8)
    np.testing.assert_allclose(model.explained, values[::-1][:4] / values.sum(), rtol=1e-10)
    found = np.array(column(components.scores(frame(spark, rows), model), "scores"))
    np.testing.assert_allclose(found, (rows - rows.mean(axis=0)) @ wanted.T, atol=1e-7)


def test_incomplete_spectra_have_no_scores(spark):
    rows = random_rows(20).tolist()
    rows += [None, [None] + rows[0][1:], [float("nan")] + rows[0][1:]]
    spectra = frame(spark, rows)
    model = components.fit_components(spectra, 2)
    assert model.rows == 20
    assert [s is None for s in column(components.scores(spectra, model), "scores")] == [False] * 20 + [True] * 3
    assert column(components.outliers(spectra, model), "outlying")[20:] == [None] * 3


def test_planted_outliers(spark):
    """One far along the first component, one off the plane of the two components; ordinary ones stay."""
    random = np.random.default_rng(3)
    plane = np.linalg.qr(random.normal(size=(12, 3)))[0].T
    rows = random.normal(size=(200, 2)) * (5, 3) @ plane[:2] + 0.05 * random.normal(size=(200, 12))
    rows[7] += 60 * plane[0]
    rows[9] += 3 * plane[2]
    spectra = frame(spark, rows)
    model = components.fit_components(spectra, 2)
    found = components.outliers(spectra, model, share=0.999).orderBy("k").collect()
    assert [r.k for r in found if r.outlying] == [7, 9]
    assert found[7].score_distance > found[7].score_limit and found[9].residual_distance > found[9].residual_limit
    centred = rows - rows.mean(axis=0)
    scores = centred @ model.loadings.T
    np.testing.assert_allclose([r.score_distance for r in found], (scores**2 / model.variances).sum(axis=1), rtol=1e-9)
    np.testing.assert_allclose([r.residual_distance for r in found], ((centred - scores @ model.loadings) ** 2).sum(axis=1), atol=1e-9)


def test_flat_spectra_have_no_components_to_measure(spark):
    spectra = frame(spark, [[1.0] * 12] * 4)
    found = components.outliers(spectra, components.fit_components(spectra, 2)).collect()
    assert {(r.score_distance, r.residual_distance, r.outlying) for r in found} == {(0.0, 0.0, False)}


def test_scores_need_no_shuffle(spark):
    spectra = frame(spark, random_rows(10), partitions=1)
    model = components.fit_components(spectra, 2)
    stored = spark.createDataFrame([(1, [0.0] * 12)], "k int, spectrum array<double>")
    plan = components.scores(from_array(stored, AXIS), model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize(("share", "freedom", "wanted"), [(0.975, 3, 9.348403604496), (0.95, 1, 3.841458820694), (0.99, 50, 76.153891249)])
def test_chi_square_quantiles(share, freedom, wanted):
    assert chi_square_quantile(share, freedom) == pytest.approx(wanted, rel=1e-9)
    assert cube_root_quantile(share, freedom) == pytest.approx(wanted, rel=0.03)


# ---- partial least squares ----------------------------------------------------------------------------------------


def nipals(x, y, count):
    """Coefficients for 1 to ``count`` components, by deflating the rows."""
    x, y = x - x.mean(axis=0), y - y.mean()
    weights, loadings, parts, squares, found = [], [], [], [], []
    for _ in range(count):
        w = x.T @ y
        w /= np.linalg.norm(w)
        t = x @ w
        p, q = x.T @ t / (t @ t), y @ t / (t @ t)
        x = x - np.outer(t, p)
        weights.append(w), loadings.append(p), parts.append(q), squares.append(q * q * (t @ t))
        w_, p_ = np.array(weights).T, np.array(loadings).T
        found.append(w_ @ np.linalg.solve(p_.T @ w_, np.array(parts)))
    return np.array(found), np.array(weights), np.array(squares)


def regression_rows(n=80):
    rows = random_rows(n)
    return rows, rows @ np.linspace(-1, 1, 12) + np.random.default_rng(5).normal(size=n)


def test_coefficients_equal_deflation_of_rows(spark):
    rows, y = regression_rows()
    model = regression.fit_regression(frame(spark, rows, more=y.tolist()), "y", 6)
    coefficients, weights, squares = nipals(rows, y, 6)
    np.testing.assert_allclose(model.coefficients, coefficients, rtol=1e-6, atol=1e-8)
    vip = np.sqrt(12 * (squares @ weights**2) / squares.sum())
    np.testing.assert_allclose(model.importance(), vip, rtol=1e-6)
    assert (model.importance() ** 2).mean() == pytest.approx(1)
    found = column(regression.predict(frame(spark, rows, more=y.tolist()), model, components=3), "predicted")
    np.testing.assert_allclose(found, y.mean() + (rows - rows.mean(axis=0)) @ coefficients[2], atol=1e-6)


def test_errors_equal_separate_fits(spark):
    rows, y = regression_rows()
    found = regression.cross_validate(frame(spark, rows, more=y.tolist()), "y", 3, F.col("k") % 5).orderBy("components").collect()
    fold = np.arange(len(y)) % 5
    for a, row in enumerate(found):
        press = 0.0
        for f in range(5):
            coefficients = nipals(rows[fold != f], y[fold != f], a + 1)[0][a]
            predicted = y[fold != f].mean() + (rows[fold == f] - rows[fold != f].mean(axis=0)) @ coefficients
            press += ((y[fold == f] - predicted) ** 2).sum()
        assert row.press == pytest.approx(press, rel=1e-6) and row.rows == len(y)
        assert row.rmse == pytest.approx(np.sqrt(press / len(y)), rel=1e-6)
        assert row.explained == pytest.approx(1 - press / ((y - y.mean()) ** 2).sum(), rel=1e-6)


def test_missing_values_take_no_part(spark):
    rows, y = regression_rows(30)
    spoilt = rows.tolist() + [None, [None] * 12, rows[0].tolist(), rows[1].tolist()]
    spectra = frame(spark, spoilt, more=[*y.tolist(), 1.0, 2.0, None, float("nan")])
    model = regression.fit_regression(spectra, "y", 2)
    assert model.rows == 30
    np.testing.assert_allclose(model.coefficients, nipals(rows, y, 2)[0], rtol=1e-6)
    predicted = column(regression.predict(spectra, model), "predicted")
    assert predicted[30:32] == [None, None] and predicted[32] == predicted[0]


def test_fewer_components_than_asked_for(spark):
    line = np.outer(np.arange(10.0), np.linspace(1, 2, 12))
    model = regression.fit_regression(frame(spark, line, more=list(np.arange(10.0) * 3)), "y", 5)
    assert model.count == 1 and model.coefficients[0] @ np.linspace(1, 2, 12) == pytest.approx(3)
    constant = frame(spark, line, more=[4.0] * 10)
    assert regression.fit_regression(constant, "y", 2).count == 0
    assert [r.rmse for r in regression.cross_validate(constant, "y", 2, F.col("k") % 2).collect()] == [0.0, 0.0]


def test_prediction_on_another_axis(spark):
    rows, y = regression_rows(30)
    model = regression.fit_regression(frame(spark, rows, more=y.tolist()), "y", 2)
    axis = [398.0 + i for i in range(30)]
    finer = np.array([np.interp(axis, AXIS, row) for row in rows])
    found = column(regression.predict(frame(spark, finer, axis), model), "predicted")
    np.testing.assert_allclose(found, column(regression.predict(frame(spark, rows), model), "predicted"), atol=1e-8)
    with pytest.raises(ValueError, match="cover"):
        regression.predict(frame(spark, rows[:, 1:], AXIS[1:]), model)


# ---- smoothing ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("width", "degree", "order"), [(5, 2, 0), (7, 3, 1), (5, 2, 2), (11, 4, 0), (3, 0, 0)])
def test_smoothing_equals_a_fit_per_window(spark, width, degree, order):
    axis = np.cumsum([1, 2, 1, 3, 1, 1, 2, 2, 1, 4, 1, 1]).astype(float)
    rows = random_rows(6, offset=0.0)
    found = column(smoothing.savitzky_golay(frame(spark, rows, axis), width, degree, order).df, "spectrum")
    for row, fitted in zip(rows, found):
        for i in range(12):
            start = min(max(i - width // 2, 0), 12 - width)
            window = slice(start, start + width)
            line = np.polynomial.Polynomial.fit(axis[window] - axis[i], row[window], degree)
            assert fitted[i] == pytest.approx((line.deriv(order) if order else line)(0.0), abs=1e-7)


def test_smoothing_of_missing_values(spark):
    row = [float(i) for i in range(12)]
    gap = row[:5] + [None] + row[6:]
    found = column(smoothing.savitzky_golay(frame(spark, [gap, None, [float("nan")] * 12]), 3, 1).df, "spectrum")
    assert [v is None for v in found[0]] == [i in (4, 5, 6) for i in range(12)]
    assert found[1] is None and found[2] == [None] * 12
    for wrong in ((4, 2, 0), (13, 2, 0), (5, 5, 0), (5, 2, 3)):
        with pytest.raises(ValueError):
            smoothing.savitzky_golay(frame(spark, [row]), *wrong)


def test_planted_spikes_are_repaired(spark):
    axis = list(range(80))
    clean = np.array([3 * np.exp(-(((np.arange(80) - c) / 14) ** 2)) + 0.01 * np.arange(80) for c in (20, 35, 60)])
    noisy = clean + 0.01 * np.random.default_rng(2).normal(size=clean.shape)
    spoilt = noisy.copy()
    for row, band in ((0, 10), (1, 0), (1, 40), (2, 79)):
        spoilt[row, band] += 5.0
    gap = spoilt.tolist() + [None, [None] * 80]
    gap[2][30] = None
    found = column(smoothing.without_spikes(frame(spark, gap, axis)).df, "spectrum")
    assert found[2][30] is None and found[3] is None and found[4] == [None] * 80
    for row in range(3):
        for band in range(80):
            if spoilt[row, band] != noisy[row, band]:
                assert abs(found[row][band] - clean[row, band]) < (0.1 if 0 < band < 79 else 0.4)
            elif (row, band) != (2, 30):
                assert found[row][band] == spoilt[row, band]
    assert column(smoothing.without_spikes(frame(spark, clean, axis)).df, "spectrum") == clean.tolist()


# ---- baselines ----------------------------------------------------------------------------------------------------


def dense_baseline(y, smoothness, asymmetry, rounds):
    known = ~np.isnan(y)
    second = np.diff(np.eye(len(y)), 2, axis=0)
    weights = known.astype(float)
    for _ in range(rounds):
        line = np.linalg.solve(np.diag(weights) + smoothness * second.T @ second, weights * np.where(known, y, 0))
        new = np.where(np.where(known, y, 0) > line, asymmetry, 1 - asymmetry) * known
        if (new == weights).all():
            break
        weights = new
    return line


def test_baseline_equals_dense_solution(spark):
    axis = list(range(60))
    random = np.random.default_rng(4)
    rows = [0.02 * np.arange(60) + 2 * np.exp(-(((np.arange(60) - c) / 3) ** 2)) + 0.02 * random.normal(size=60) for c in range(10, 50, 4)]
    rows[3][20:23] = np.nan
    rows[4][0] = np.nan
    few = np.full(60, np.nan)
    few[:2] = 1.0
    spectra = frame(spark, [*rows, few, None], axis, partitions=2)
    found = column(baseline.without_baseline(spectra, 1e3, 0.02, 30).df, "spectrum")
    for row, left in zip(rows, found):
        wanted = row - dense_baseline(row, 1e3, 0.02, 30)
        assert [v is None for v in left] == np.isnan(row).tolist()
        np.testing.assert_allclose([np.nan if v is None else v for v in left], wanted, atol=1e-8)
    assert found[10] == [None] * 60 and found[11] is None


def test_baseline_does_not_depend_on_the_batch():
    rows = random_rows(7, 30, offset=0.0)
    every = baseline.asymmetric_baseline(rows, 100.0, 0.01, 20)
    assert all((baseline.asymmetric_baseline(rows[i : i + 1], 100.0, 0.01, 20) == every[i]).all() for i in range(7))


# ---- corrections --------------------------------------------------------------------------------------------------


def test_scatter_equals_least_squares(spark):
    rows = np.abs(random_rows(25, offset=20.0))
    spectra = frame(spark, [*rows.tolist(), None, [None] + rows[0].tolist()[1:]])
    model = correction.learn_scatter(frame(spark, rows))
    found = column(correction.correct_scatter(spectra, model).df, "spectrum")
    u = np.linspace(-1, 1, 12)
    terms = np.column_stack([rows.mean(axis=0), np.ones(12), u, u * u])
    for row, fixed in zip(rows, found):
        share, *polynomial = np.linalg.lstsq(terms, row, rcond=None)[0]
        np.testing.assert_allclose(fixed, (row - terms[:, 1:] @ polynomial) / share, rtol=1e-8)
    assert found[25:] == [None, None]
    with pytest.raises(ValueError, match="polynomial"):
        correction.learn_scatter(frame(spark, [u * u, u]))


def test_scaling_of_bands(spark):
    rows = random_rows(15, offset=3.0)
    rows[:, 4] = 7.0
    gaps = rows.tolist()
    gaps[0][2], gaps[1][2] = None, float("nan")
    spectra = frame(spark, [*gaps, None])
    learned = correction.learn_scale(spectra)
    assert learned.known.tolist() == [15 - 2 * (i == 2) for i in range(12)]
    wanted = rows.copy()
    wanted[:2, 2] = np.nan
    wanted = (wanted - np.nanmean(wanted, axis=0)) / np.where(np.nanstd(wanted, axis=0) > 0, np.nanstd(wanted, axis=0, ddof=1), np.nan)
    found = column(correction.scale_bands(spectra, learned).df, "spectrum")
    assert found[15] is None
    np.testing.assert_allclose(np.array([[np.nan if v is None else v for v in r] for r in found[:15]]), wanted, rtol=1e-9)
    pareto = column(correction.scale_bands(spectra, learned, "pareto").df, "spectrum")
    assert pareto[3][0] == pytest.approx((rows[3, 0] - rows[:, 0].mean()) / np.sqrt(rows[:, 0].std(ddof=1)))


def test_noisy_ends_are_dropped(spark):
    random = np.random.default_rng(8)
    level = random.normal(size=(60, 1))
    rows = level * np.ones(12) + 0.05 * random.normal(size=(60, 12))
    rows[:, :2] = random.normal(size=(60, 2))
    rows[:, 11] = random.normal(size=60)
    kept, report = correction.trim_tails(frame(spark, rows), least=3.0)
    dropped = [r.band for r in report.orderBy("band").collect() if r.dropped]
    assert dropped[:2] == AXIS[:2] and dropped[-1] == AXIS[-1]
    assert kept.axis == tuple(v for v in AXIS if v not in dropped) and len(kept.axis) >= 7
    assert len(kept.df.first().spectrum) == len(kept.axis)
    with pytest.raises(ValueError, match="every band"):
        correction.trim_tails(frame(spark, random.normal(size=(50, 12))), least=10.0)
