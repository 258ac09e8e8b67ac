"""Corrections that learn from the whole table first: scatter, scale of the bands, noisy ends of the axis.

What is learned are a few numbers per band, from one aggregation; it is applied as expressions on the array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.expressions import bound, missing_to_null
from spectraloom.functions.names import col, number_array
from spectraloom.functions.vectors import number_table, projected
from spectraloom.operators.preprocess import changed
from spectraloom.operators.spectra import SpectralFrame
from spectraloom.plans.moments import complete

SCALES = ("sd", "pareto", "none")


@dataclass(frozen=True)
class BandScale:
    """Mean and standard deviation (n - 1) of every band, and the number of values; NaN where there are too few."""

    axis: tuple[float, ...]
    mean: np.ndarray
    sd: np.ndarray
    known: np.ndarray


def learn_scale(spectra: SpectralFrame) -> BandScale:
    """One aggregation, combined before the shuffle; the driver gets a row per band. Missing values are left out."""
    rows = spectra.df.select(F.posexplode_outer(col(spectra.column)).alias("pos", "value")).where(F.col("pos").isNotNull())
    x = missing_to_null(F.col("value"))
    found = rows.groupBy("pos").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(x).alias("known")).collect()
    mean, sd, known = np.full((3, len(spectra.axis)), np.nan)
    known[:] = 0
    for row in found:
        known[row.pos] = row.known
        mean[row.pos], sd[row.pos] = (np.nan if v is None else v for v in (row.mean, row.sd))
    return BandScale(spectra.axis, mean, sd, known)


def scale_bands(spectra: SpectralFrame, learned: BandScale, by: str = "sd") -> SpectralFrame:
    """Every band less its mean, over its standard deviation (``sd``), the root of it (``pareto``) or nothing (``none``).

    A band that does not vary, or has no known values, becomes missing ones.
    """
    if by not in SCALES:
        raise ValueError(f"unknown scale {by!r}; one of {SCALES}")
    if spectra.axis != learned.axis:
        raise ValueError("the spectra have another axis than the scale")
    divisor = {"sd": learned.sd, "pareto": np.sqrt(learned.sd), "none": np.ones(len(learned.sd))}[by]
    means, divisors = number_array(map(float, learned.mean)), number_array(float(d) if d else float("nan") for d in divisor)

    def scaled(y: Column) -> Column:
        return F.when(y.isNotNull(), F.transform(y, lambda x, i: missing_to_null((x - F.get(means, i)) / F.get(divisors, i))))

    return changed(spectra, scaled)


def noise_and_signal(spectra: SpectralFrame) -> list[tuple[float, float]]:
    """Variance of the noise and of the values of every band.

    Noise is what a value differs from the straight line between its neighbours, over what independent noise of variance 1
    would give there. The outermost bands get the noise of the next ones.
    """
    axis = spectra.axis
    if len(axis) < 3:
        raise ValueError("noise needs three bands")
    right = [(b - a) / (c - a) for a, b, c in zip(axis, axis[1:], axis[2:])]
    shares, size = number_array(right), len(axis)
    weight = number_array([1 + r * r + (1 - r) * (1 - r) for r in right])

    def steps(y: Column) -> Column:
        def off(x: Column, i: Column) -> Column:
            r = F.get(shares, i - 1)
            line = F.get(y, i - 1) * (1 - r) + F.get(y, i + 1) * r
            inside = (i > 0) & (i < size - 1)
            return F.struct(x.alias("x"), F.when(inside, (x - line) * (x - line) / F.get(weight, i - 1)).alias("noise"))

        return F.transform(y, off)

    pairs = bound(F.transform(col(spectra.column), missing_to_null), steps)
    rows = spectra.df.select(F.posexplode_outer(pairs).alias("pos", "pair")).where(F.col("pos").isNotNull())
    found = rows.groupBy("pos").agg(F.avg("pair.noise").alias("noise"), F.var_pop("pair.x").alias("signal"))
    by_band = {row.pos: (row.noise, row.signal) for row in found.collect()}
    told = [by_band.get(i, (None, None)) for i in range(size)]
    return [(told[min(max(i, 1), size - 2)][0], told[i][1]) for i in range(size)]


def trim_tails(spectra: SpectralFrame, least: float = 1.0) -> tuple[SpectralFrame, DataFrame]:
    """Drops bands from both ends of the axis as long as ``least`` times their noise exceeds their variance, or is unknown.

    Returns the rest and a report of all bands: ``band, noise, signal, dropped``. An axis of noise only is an error.
    """
    told = noise_and_signal(spectra)
    fine = [i for i, (noise, signal) in enumerate(told) if noise is not None and signal is not None and noise * least <= signal]
    if not fine:
        raise ValueError("noise exceeds signal in every band")
    kept = range(fine[0], fine[-1] + 1)
    rows = [(band, *told[i], i not in kept) for i, band in enumerate(spectra.axis)]
    report = spectra.df.sparkSession.createDataFrame(rows, "band double, noise double, signal double, dropped boolean")
    return spectra.take(list(kept)), report


@dataclass(frozen=True)
class ScatterModel:
    """``solve`` turns a spectrum into what it takes of the mean spectrum and of powers of the axis, by least squares."""

    axis: tuple[float, ...]
    powers: np.ndarray
    solve: np.ndarray


def learn_scatter(spectra: SpectralFrame, degree: int = 2) -> ScatterModel:
    """From the mean of every band and the powers 0 to ``degree`` of the axis, scaled to -1 .. 1. One factorisation for all
    rows. A mean that such powers explain alone is an error: what is chemical could not be told from what is scatter."""
    mean = learn_scale(spectra).mean
    if len(spectra.axis) < degree + 2 or np.isnan(mean).any():
        raise ValueError("the mean spectrum must be known, on more bands than there are terms")
    axis = np.asarray(spectra.axis)
    powers = np.vander(2 * (axis - axis[0]) / (axis[-1] - axis[0]) - 1, degree + 1, increasing=True)
    smooth = powers @ np.linalg.lstsq(powers, mean, rcond=None)[0]
    if np.linalg.norm(mean - smooth) <= 1e-9 * np.linalg.norm(mean):
        raise ValueError("the mean spectrum is a polynomial of the axis")
    orthogonal, triangle = np.linalg.qr(np.column_stack([mean, powers]))
    return ScatterModel(spectra.axis, powers.T, np.linalg.solve(triangle, orthogonal.T))


def correct_scatter(spectra: SpectralFrame, model: ScatterModel) -> SpectralFrame:
    """Extended multiplicative scatter correction: each spectrum less its polynomial part, over its share of the mean spectrum.

    A spectrum with a missing value, or without any share, becomes NULL.
    """
    if spectra.axis != model.axis:
        raise ValueError("the spectra have another axis than the model")
    columns = number_table(model.powers.T)

    def corrected(y: Column) -> Column:
        def parts(c: Column) -> Column:
            polynomial = F.slice(c, 2, F.lit(len(model.powers)))
            share = F.nullif(F.get(c, 0), F.lit(0.0))
            value = F.zip_with(y, columns, lambda x, u: (x - F.aggregate(F.zip_with(u, polynomial, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)) / share)
            return F.when(share.isNotNull(), value)

        return F.when(complete(y, len(model.axis)), bound(projected(y, model.solve), parts))

    return changed(spectra, corrected)
