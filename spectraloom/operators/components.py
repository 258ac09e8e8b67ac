"""Principal components of spectra, and distances that tell outliers.

The covariance comes from one distributed pass (``plans.moments``), its eigenvectors from the driver, which holds a matrix
of bands by bands. Scores and distances are expressions on the array: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.distributions import chi_square_quantile, cube_root_quantile
from spectraloom.functions.expressions import bound
from spectraloom.functions.names import col, number_array
from spectraloom.functions.vectors import dot, minus, projected
from spectraloom.operators.spectra import SpectralFrame
from spectraloom.plans.moments import complete, moments


@dataclass(frozen=True)
class Components:
    """``loadings[k]`` is the k-th eigenvector, ``variances[k]`` its eigenvalue (divisor n - 1); ``total`` is their sum over
    all components, ``rows`` the spectra they were learned from."""

    axis: tuple[float, ...]
    mean: np.ndarray
    loadings: np.ndarray
    variances: np.ndarray
    total: float
    rows: int

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.total if self.total else np.zeros(len(self.variances))


def upright(vectors: np.ndarray) -> np.ndarray:
    """Rows turned so that the largest entry, the first of equal ones, is positive."""
    largest = np.abs(vectors).argmax(axis=1)
    return vectors * np.where(vectors[np.arange(len(vectors)), largest] < 0, -1.0, 1.0)[:, None]


def fit_components(spectra: SpectralFrame, count: int) -> Components:
    """The first ``count`` components (at most as many as there are bands) of all spectra without missing values."""
    size = len(spectra.axis)
    found = moments(spectra.df, col(spectra.column), size).get(0)
    if found is None or found.n < 2:
        raise ValueError("components need two spectra without missing values")
    values, vectors = np.linalg.eigh(found.covariance)
    order = np.argsort(-values, kind="stable")[: min(count, size)]
    total = float(np.trace(found.covariance))
    return Components(spectra.axis, found.mean, upright(vectors[:, order].T), np.maximum(values[order], 0.0), total, found.n)


def loadings_table(spectra: SpectralFrame, model: Components) -> DataFrame:
    """One row per component and band: ``component, variance, explained, band, loading``. Its size is that of the model."""
    rows = [
        (k + 1, float(model.variances[k]), float(model.explained[k]), band, float(model.loadings[k, j]))
        for k in range(len(model.loadings))
        for j, band in enumerate(model.axis)
    ]
    return spectra.df.sparkSession.createDataFrame(rows, "component int, variance double, explained double, band double, loading double")


def centred(spectra: SpectralFrame, model: Components) -> Column:
    """Deviations from the model's mean; NULL for a spectrum with missing values."""
    if spectra.axis != model.axis:
        raise ValueError("the spectra have another axis than the model: resample them first")
    values = col(spectra.column)
    return F.when(complete(values, len(model.axis)), minus(values, model.mean))


def scores(spectra: SpectralFrame, model: Components, column: str = "scores") -> DataFrame:
    """The descriptive columns and an array with a score per component; NULL where the spectrum has missing values."""
    found = bound(centred(spectra, model), lambda c: F.when(c.isNotNull(), projected(c, model.loadings)))
    return spectra.df.select(*map(col, spectra.metadata), found.alias(column))


@dataclass(frozen=True)
class Limits:
    score: float
    residual: float


def distances(spectra: SpectralFrame, model: Components) -> DataFrame:
    """The descriptive columns, ``score_distance`` (squared scores over their variances, summed) and ``residual_distance``
    (what the components leave of the squared deviations). Components without variance take no part."""
    used = [k for k, v in enumerate(model.variances) if v > 1e-12 * model.total]
    weights = number_array([float(1 / model.variances[k]) for k in used]) if used else F.array().cast("array<double>")

    def both(c: Column) -> Column:
        def told(t: Column) -> Column:
            score = F.aggregate(F.zip_with(t, weights, lambda x, w: x * x * w), F.lit(0.0), lambda a, b: a + b)
            return F.struct(score.alias("score"), F.greatest(dot(c, c) - dot(t, t), F.lit(0.0)).alias("residual"))

        return F.when(c.isNotNull(), bound(projected(c, model.loadings[used]), told))

    rows = spectra.df.select(*map(col, spectra.metadata), bound(centred(spectra, model), both).alias("_both"))
    found = [F.col("_both")["score"].alias("score_distance"), F.col("_both")["residual"].alias("residual_distance")]
    return rows.select(*map(col, spectra.metadata), *found)


def distance_limits(found: DataFrame, model: Components, share: float = 0.975) -> Limits:
    """What ``share`` of ordinary spectra stay within.

    Score distances follow a chi-square distribution with a degree of freedom per component. Residual distances follow a
    scaled one, whose scale and freedom come from the mean and the variance of all of them (one aggregation).
    """
    used = int((model.variances > 1e-12 * model.total).sum())
    mean, spread = found.agg(F.avg("residual_distance"), F.var_pop("residual_distance")).first()
    residual = mean or 0.0
    if mean and spread:
        residual = spread / (2 * mean) * cube_root_quantile(share, 2 * mean * mean / spread)
    return Limits(chi_square_quantile(share, used) if used else 0.0, residual)


def outliers(spectra: SpectralFrame, model: Components, share: float = 0.975) -> DataFrame:
    """``distances`` with ``score_limit``, ``residual_limit`` and whether a spectrum is ``outlying`` in either.

    Limits are learned from the spectra given, which are read once for that. A spectrum with missing values has NULLs.
    """
    found = distances(spectra, model)
    limits = distance_limits(found, model, share)
    beyond = (F.col("score_distance") > limits.score) | (F.col("residual_distance") > limits.residual)
    return found.select("*", F.lit(limits.score).alias("score_limit"), F.lit(limits.residual).alias("residual_limit"), beyond.alias("outlying"))
