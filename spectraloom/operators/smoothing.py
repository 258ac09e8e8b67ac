"""Smoothing of spectra and removal of spikes, as expressions on the array: no shuffle, no Python at run time."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from spectraloom.functions.expressions import bound
from spectraloom.functions.names import number_array
from spectraloom.functions.vectors import dot, number_table
from spectraloom.operators.preprocess import changed
from spectraloom.operators.spectra import SpectralFrame

#: Scales the median of absolute deviations to the standard deviation of normal values.
NORMAL_MAD = 1.4826


def window_starts(size: int, width: int) -> list[int]:
    """Where the window of each position begins: centred, moved inwards at the ends."""
    if width % 2 == 0 or not 0 < width <= size:
        raise ValueError(f"a window must have an odd number of bands, at most {size}")
    return [min(max(i - width // 2, 0), size - width) for i in range(size)]


def local_weights(axis: Sequence[float], width: int, degree: int, order: int = 0) -> np.ndarray:
    """Row i holds what the values of position i's window count towards the fitted polynomial (or its derivative) there.

    The polynomial is the least-squares one over the window, on the axis as it is, evenly spaced or not.
    """
    if not 0 <= order <= degree < width:
        raise ValueError("0 <= order <= degree < width is needed")
    rows = []
    for i, start in enumerate(window_starts(len(axis), width)):
        offsets = np.asarray(axis[start : start + width]) - axis[i]
        scale = np.abs(offsets).max()
        terms = np.vander(offsets / scale, degree + 1, increasing=True)
        rows.append(np.linalg.pinv(terms)[order] * math.factorial(order) / scale**order)
    return np.array(rows)


def savitzky_golay(spectra: SpectralFrame, width: int = 11, degree: int = 2, order: int = 0) -> SpectralFrame:
    """Local polynomial smoothing (order 0) or the derivative of that order, at every band.

    Weights are computed once. Bands near an end use the first or last whole window. A value is missing where its window
    holds a missing value.
    """
    weights = local_weights(spectra.axis, width, degree, order)
    starts = number_array(window_starts(len(spectra.axis), width))

    def fitted(y: Column) -> Column:
        values = F.zip_with(number_table(weights), starts, lambda row, start: dot(row, F.slice(y, start + 1, F.lit(width))))
        return F.when(y.isNotNull(), values)

    return changed(spectra, fitted)


def middle(values: Column) -> Column:
    """The median of the values that are not missing."""

    def of(known: Column) -> Column:
        half = F.floor((F.size(known) - 1) / 2).cast("int")
        return (F.get(known, half) + F.get(known, F.size(known) - 1 - half)) / 2

    return bound(F.array_sort(F.filter(values, lambda x: x.isNotNull())), of)


def without_spikes(spectra: SpectralFrame, width: int = 7, threshold: float = 6.0, least: float = 0.02) -> SpectralFrame:
    """Values that stand out from the running median are replaced by the median of their unsuspicious neighbours.

    One stands out if it lies beyond the medians at its band and the next ones by more than ``threshold`` robust standard
    deviations of the spectrum's distances from its medians, and by more than ``least`` of their extent. Windows are centred
    and get narrower towards the ends, down to three bands; at an end the line of the next two medians counts as one. So
    neither a slope nor the neighbour of a spike is one. Where no neighbour is left, the running median stands in. Other
    values, and missing ones, stay.
    """
    size, half = len(spectra.axis), width // 2
    if width < 3:
        raise ValueError("a window must have three bands at least")
    near = number_array(window_starts(size, width))
    reach = [max(1, min(half, i, size - 1 - i)) for i in range(size)]
    starts = number_array([min(max(i - r, 0), size - 3) for i, r in enumerate(reach)])
    widths = number_array([2 * r + 1 for r in reach])

    def expected(y: Column) -> Column:
        def ends(medians: Column) -> Column:
            def line(end: int, inner: int) -> Column:
                return 2 * F.get(medians, F.lit(end)) - F.get(medians, F.lit(inner))

            first, last = line(0, 2), line(size - 1, size - 3)
            at = F.transform(medians, lambda m, i: F.when(i == 0, first).when(i == size - 1, last).otherwise(m))
            return F.struct(medians.alias("medians"), at.alias("at"))

        return bound(F.zip_with(starts, widths, lambda start, n: middle(F.slice(y, start + 1, n))), ends)

    def repaired(y: Column, found: Column) -> Column:
        medians, at = found["medians"], found["at"]
        away = F.zip_with(y, at, lambda x, m: F.abs(x - m))
        limit = F.greatest(middle(away) * (NORMAL_MAD * threshold), (F.array_max(medians) - F.array_min(medians)) * least)

        def mended(kept: Column) -> Column:
            def value(x: Column, i: Column) -> Column:
                others = middle(F.slice(kept, F.get(near, i) + 1, F.lit(width)))
                return F.when(x.isNull() | F.get(kept, i).isNotNull(), x).otherwise(F.coalesce(others, F.get(medians, i)))

            return F.transform(y, value)

        def unsuspicious(bar: Column) -> Column:
            def kept(x: Column, i: Column) -> Column:
                around = F.slice(at, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3))
                return F.when(F.greatest(x - F.array_max(around), F.array_min(around) - x) <= bar, x)

            return F.transform(y, kept)

        return bound(limit, lambda bar: bound(unsuspicious(bar), mended))

    return changed(spectra, lambda y: F.when(y.isNotNull(), bound(expected(y), lambda found: repaired(y, found))))
