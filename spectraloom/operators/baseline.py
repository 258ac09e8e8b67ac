"""Baselines by asymmetric least squares."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from spectraloom.functions.expressions import missing_to_null
from spectraloom.functions.names import col
from spectraloom.operators.spectra import SpectralFrame

#: Least known values a baseline needs: fewer leave it undetermined.
LEAST_KNOWN = 3


def roughness(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three diagonals (main, first, second) of D'D, D being the second differences of ``size`` values."""
    main, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for i in range(size - 2):
        main[i : i + 3] += (1.0, 4.0, 1.0)
        first[i : i + 2] += -2.0
        second[i] += 1.0
    return main, first, second


def solve_banded(main: np.ndarray, first: np.ndarray, second: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves one symmetric pentadiagonal system per column; ``main`` differs by column, the outer diagonals do not.

    An LDL' elimination along the positions, all columns at a time.
    """
    size = len(main)
    pivot, one, two, out = np.empty_like(main), np.zeros_like(main), np.zeros_like(main), right.copy()
    for i in range(size):
        pivot[i] = main[i]
        lower = np.full(main.shape[1], first[i])
        if i >= 1:
            pivot[i] -= one[i - 1] ** 2 * pivot[i - 1]
            lower -= one[i - 1] * two[i - 1] * pivot[i - 1]
            out[i] -= one[i - 1] * out[i - 1]
        if i >= 2:
            pivot[i] -= two[i - 2] ** 2 * pivot[i - 2]
            out[i] -= two[i - 2] * out[i - 2]
        one[i], two[i] = lower / pivot[i], second[i] / pivot[i]
    out /= pivot
    for i in reversed(range(size)):
        if i + 1 < size:
            out[i] -= one[i] * out[i + 1]
        if i + 2 < size:
            out[i] -= two[i] * out[i + 2]
    return out


def asymmetric_baseline(values: np.ndarray, smoothness: float, asymmetry: float, rounds: int) -> np.ndarray:
    """Baselines of the rows of a matrix; NaN are missing values and do not weigh. Rows with too few known ones get NaN."""
    known = ~np.isnan(values.T)
    usable = known.sum(axis=0) >= LEAST_KNOWN
    data = np.where(known, values.T, 0.0)[:, usable]
    known = known[:, usable]
    main, first, second = (smoothness * d for d in roughness(len(data)))
    weights, lines = known.astype(float), data
    for _ in range(rounds):
        lines = solve_banded(main[:, None] + weights, first, second, weights * data)
        changed = np.where(data > lines, asymmetry, 1 - asymmetry) * known
        if np.array_equal(changed, weights):
            break
        weights = changed
    found = np.full(values.shape, np.nan)
    found[usable] = lines.T
    return found


def baselines(column: Column, size: int, smoothness: float, asymmetry: float, rounds: int) -> Column:
    @F.arrow_udf("array<double>")
    def fitted(spectra: pa.Array) -> pa.Array:
        there = spectra.is_valid().to_numpy(zero_copy_only=False)
        flat = spectra.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        found = iter(asymmetric_baseline(flat, smoothness, asymmetry, rounds))
        return pa.array([next(found) if t else None for t in there], pa.list_(pa.float64()))

    return fitted(column)


def without_baseline(spectra: SpectralFrame, smoothness: float = 1e5, asymmetry: float = 0.01, rounds: int = 20) -> SpectralFrame:
    """Each spectrum less its baseline, the curve z that minimises sum w (y - z)^2 + smoothness * sum (second differences of z)^2.

    The weight w of a value is ``asymmetry`` above the curve and 1 - ``asymmetry`` elsewhere, found by fitting again until no
    weight changes, at most ``rounds`` times; the first fit weighs all alike. Missing values do not weigh and stay missing;
    a spectrum with fewer than three known values becomes missing ones. Batches are solved together, position by position,
    with the result of each row independent of its batch.
    """
    if len(spectra.axis) < LEAST_KNOWN:
        raise ValueError("a baseline needs three bands")
    if not 0 < asymmetry < 1 or smoothness <= 0 or rounds < 1:
        raise ValueError("asymmetry between 0 and 1, a positive smoothness and a round at least are needed")
    values = F.transform(col(spectra.column), lambda x: F.coalesce(x, F.lit(float("nan"))))
    lines = baselines(values, len(spectra.axis), smoothness, asymmetry, rounds)
    left = F.zip_with(col(spectra.column), lines, lambda y, z: missing_to_null(y - z)).alias(spectra.column)
    return spectra.with_df(spectra.df.select(*map(col, spectra.metadata), left))
