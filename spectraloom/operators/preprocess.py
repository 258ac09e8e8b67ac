"""Row-wise preprocessing of spectra, as expressions on the array: no shuffle, no Python.

Missing values (NULL or NaN) stay missing and are left out of means and sums.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spectraloom.functions.expressions import bound, missing_to_null
from spectraloom.functions.names import band_label, col, number_array
from spectraloom.operators.spectra import SpectralFrame


def changed(spectra: SpectralFrame, body: Callable[[Column], Column]) -> SpectralFrame:
    values = bound(F.transform(col(spectra.column), missing_to_null), body).alias(spectra.column)
    return spectra.with_df(spectra.df.select(*map(col, spectra.metadata), values))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def known(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda n, x: n + F.when(x.isNull(), 0.0).otherwise(1.0))


def snv(spectra: SpectralFrame) -> SpectralFrame:
    """Standard normal variate: each spectrum less its mean, over its standard deviation (n - 1). A constant one: NULL values."""

    def scaled(y: Column, mean: Column) -> Column:
        squares = total(F.transform(y, lambda x: (x - mean) * (x - mean)))
        spread = F.sqrt(squares / F.nullif(known(y) - 1, F.lit(0.0)))
        return bound(F.nullif(spread, F.lit(0.0)), lambda s: F.transform(y, lambda x: (x - mean) / s))

    return changed(spectra, lambda y: bound(total(y) / F.nullif(known(y), F.lit(0.0)), lambda mean: scaled(y, mean)))


def unit_area(spectra: SpectralFrame) -> SpectralFrame:
    """Each spectrum over the sum of its absolute values. All zero: NULL values."""
    return changed(spectra, lambda y: bound(F.nullif(total(F.transform(y, F.abs)), F.lit(0.0)), lambda s: F.transform(y, lambda x: x / s)))


def unit_length(spectra: SpectralFrame) -> SpectralFrame:
    """Each spectrum over the root of the sum of its squares. All zero: NULL values."""
    return changed(spectra, lambda y: bound(F.sqrt(F.nullif(total(F.transform(y, lambda x: x * x)), F.lit(0.0))), lambda s: F.transform(y, lambda x: x / s)))


def derivative(spectra: SpectralFrame) -> SpectralFrame:
    """Differences of neighbouring values over those of their bands, at the bands' middles."""
    axis: Sequence[float] = spectra.axis
    if len(axis) < 2:
        raise ValueError("a derivative needs two bands")
    middles = tuple((a + b) / 2 for a, b in zip(axis, axis[1:]))
    labels = tuple(map(band_label, middles))
    if len(set(labels)) < len(labels):
        raise ValueError("the bands are too close for two-decimal names of their middles")
    steps = number_array([b - a for a, b in zip(axis, axis[1:])])

    def slopes(y: Column) -> Column:
        return F.when(y.isNotNull(), F.transform(steps, lambda step, i: (F.get(y, i + 1) - F.get(y, i)) / step))

    found = changed(spectra, slopes)
    return SpectralFrame(found.df, middles, labels, found.column)
