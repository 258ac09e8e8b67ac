"""Partial least squares: a property predicted from spectra.

One distributed pass gathers the joint moments of spectra and property by fold. Fits, importance and cross-validation all
come from these: a training set is the merger of the other folds, and the squared error of a fold follows from its moments,
so folds cost no further scans. Predictions are expressions on the array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.expressions import bound
from spectraloom.functions.names import band_label, col, number_array
from spectraloom.functions.vectors import dot
from spectraloom.operators.resample import interpolated_on
from spectraloom.operators.spectra import SpectralFrame
from spectraloom.plans.moments import Moments, complete, merged, moments

#: A component is not fitted where the covariance left with the property is this share of the first one's, or less.
LEAST_LEFT = 1e-10


@dataclass(frozen=True)
class Regression:
    """``coefficients[a]`` and ``intercepts[a]`` predict with a + 1 components; ``weights[a]`` has unit length, ``explained[a]``
    is the sum of squares of the property that component a + 1 accounts for."""

    axis: tuple[float, ...]
    intercepts: np.ndarray
    coefficients: np.ndarray
    weights: np.ndarray
    explained: np.ndarray
    rows: int

    @property
    def count(self) -> int:
        return len(self.coefficients)

    def importance(self) -> np.ndarray:
        """Variable importance of every band with all components; their squares have the mean 1."""
        if not self.explained.sum():
            return np.zeros(len(self.axis))
        return np.sqrt(len(self.axis) * (self.explained @ self.weights**2) / self.explained.sum())


def simpls(found: Moments, axis: tuple[float, ...], count: int) -> Regression:
    """Components from cross products alone: the last variable of ``found`` is the property.

    Each component's weights are the covariances with the property that are left once the loadings so far are projected out.
    """
    xx, xy, yy = found.scatter[:-1, :-1], found.scatter[:-1, -1], found.scatter[-1, -1]
    left, unexplained = xy.copy(), xy.copy()
    basis = np.zeros((0, len(axis)))
    coefficients, weights, explained = [], [], []
    total = np.zeros(len(axis))
    for _ in range(min(count, len(axis), max(found.n - 1, 0))):
        norm = np.linalg.norm(left)
        if not yy or norm <= LEAST_LEFT * np.linalg.norm(xy):
            break
        direction = left / norm
        spread = direction @ xx @ direction
        if spread <= 0:
            break
        direction = direction / np.sqrt(spread)
        loading, part = xx @ direction, float(xy @ direction)
        weights.append(unexplained / np.linalg.norm(unexplained))
        unexplained = unexplained - loading * part
        total = total + direction * part
        coefficients.append(total)
        explained.append(part * part)
        new = loading - basis.T @ (basis @ loading)
        new = new - basis.T @ (basis @ new)
        basis = np.vstack([basis, new / np.linalg.norm(new)])
        left = left - basis.T @ (basis @ left)
    shape = (len(coefficients), len(axis))
    coefficients = np.array(coefficients).reshape(shape)
    intercepts = found.mean[-1] - coefficients @ found.mean[:-1]
    return Regression(axis, intercepts, coefficients, np.array(weights).reshape(shape), np.array(explained), found.n)


def joint(spectra: SpectralFrame, target: str, fold: Column | None = None) -> dict[int, Moments]:
    """Joint moments of bands and property, by fold; rows with a missing value in either take no part."""
    both = F.concat(col(spectra.column), F.array(col(target).cast("double")))
    return moments(spectra.df, both, len(spectra.axis) + 1, fold)


def fit_regression(spectra: SpectralFrame, target: str, count: int) -> Regression:
    """Up to ``count`` components; fewer where the spectra have no more that goes along with the property."""
    found = joint(spectra, target).get(0)
    if found is None or found.n < 2:
        raise ValueError("a regression needs two rows without missing values")
    return simpls(found, spectra.axis, count)


def squared_error(fold: Moments, training: Moments, intercept: float, coefficients: np.ndarray) -> float:
    """The sum over a fold's rows of squared differences between the property and its prediction."""
    step = np.append(-coefficients, 1.0)
    bias = step @ fold.mean - intercept
    return max(float(step @ fold.scatter @ step), 0.0) + fold.n * bias * bias


def cross_validate(spectra: SpectralFrame, target: str, count: int, fold: Column) -> DataFrame:
    """Errors for 1 to ``count`` components, each row predicted by a model that was learned without its fold.

    ``fold`` gives a row's fold as an int, e.g. a hash of its identity modulo ten. Returns ``components, rows, press`` (the
    sum of squared errors), ``rmse`` and ``explained`` (1 - press over the sum of squares about the mean of all rows). Where a
    training set has fewer components, its last model stands in for the rest. The driver holds a matrix per fold.
    """
    folds, size = joint(spectra, target, fold), len(spectra.axis) + 1
    if len(folds) < 2:
        raise ValueError("cross-validation needs two folds with rows")
    press = np.zeros(count)
    for held, own in folds.items():
        training = merged((m for name, m in folds.items() if name != held), size)
        model = simpls(training, spectra.axis, count)
        for a in range(count):
            at = min(a, model.count - 1)
            intercept, coefficients = (model.intercepts[at], model.coefficients[at]) if model.count else (training.mean[-1], np.zeros(size - 1))
            press[a] += squared_error(own, training, intercept, coefficients)
    every = merged(folds.values(), size)
    spread = every.scatter[-1, -1]
    rows = [(a + 1, every.n, float(p), float(np.sqrt(p / every.n)), float(1 - p / spread) if spread else None) for a, p in enumerate(press)]
    return spectra.df.sparkSession.createDataFrame(rows, "components int, rows long, press double, rmse double, explained double")


def importance_table(spectra: SpectralFrame, model: Regression) -> DataFrame:
    """``band, importance, coefficient`` with all components; its size is that of the axis."""
    last = model.coefficients[-1] if model.count else np.zeros(len(model.axis))
    rows = [(b, float(v), float(c)) for b, v, c in zip(model.axis, model.importance(), last)]
    return spectra.df.sparkSession.createDataFrame(rows, "band double, importance double, coefficient double")


def predict(spectra: SpectralFrame, model: Regression, components: int | None = None, column: str = "predicted") -> DataFrame:
    """The descriptive columns and the predicted property; NULL for a spectrum with missing values.

    Spectra on another axis are brought to the model's by linear interpolation first; one that does not reach its ends is
    an error.
    """
    if model.count == 0:
        raise ValueError("the model has no components")
    if spectra.axis != model.axis:
        if spectra.axis[0] > model.axis[0] or spectra.axis[-1] < model.axis[-1]:
            raise ValueError("the spectra do not cover the model's axis")
        spectra = interpolated_on(spectra, model.axis, tuple(map(band_label, model.axis)))
    at = (components or model.count) - 1
    if not 0 <= at < model.count:
        raise ValueError(f"the model has {model.count} components")
    coefficients, intercept = number_array(map(float, model.coefficients[at])), F.lit(float(model.intercepts[at]))
    value = bound(col(spectra.column), lambda x: F.when(complete(x, len(model.axis)), dot(x, coefficients) + intercept))
    return spectra.df.select(*map(col, spectra.metadata), value.alias(column))
