"""Resampling of spectra to a regular axis by linear interpolation."""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.expressions import bound, missing_to_null
from spectraloom.functions.names import band_label, col, number_array
from spectraloom.operators.spectra import SpectralFrame, pack_bands, split_roles


@dataclass(frozen=True)
class AxisPlan:
    """A target axis, and for each of its points the left source node and the weight of the right one."""

    axis: tuple[float, ...]
    nodes: tuple[tuple[int, float], ...]


def target_axis(source: Sequence[float], step: float, lo: float | None = None, hi: float | None = None) -> list[float]:
    """``lo, lo + step, ...`` up to ``hi``; the ends default to the source's. Starts at ``lo``, not at a multiple."""
    lo = float(source[0] if lo is None else lo)
    hi = float(source[-1] if hi is None else hi)
    if lo >= hi:
        raise ValueError("the lower end must be less than the upper end")
    if step <= 0:
        raise ValueError("the step must be positive")
    points = [lo + i * step for i in range(math.floor((hi - lo) / step) + 2)]
    return [x for x in points if x <= hi]


def plan_axis(source: Sequence[float], target: Sequence[float]) -> AxisPlan:
    """Beyond either end the end value holds; on a node only that node counts, whatever its neighbour."""
    nodes = []
    for x in target:
        right = bisect.bisect_right(source, x)
        if right == 0:
            nodes.append((0, 0.0))
        elif right == len(source):
            nodes.append((len(source) - 1, 0.0))
        else:
            i = right - 1
            nodes.append((i, (x - source[i]) / (source[right] - source[i])))
    return AxisPlan(tuple(target), tuple(nodes))


def resample(spectra: SpectralFrame, step: float, lo: float | None = None, hi: float | None = None) -> SpectralFrame:
    """Spectra on a regular axis. A narrow projection: no shuffle, nothing leaves the JVM.

    A missing neighbour gives a missing value.
    """
    if not spectra.axis:
        raise ValueError("no spectral bands: their names must be plain numbers")
    target = target_axis(spectra.axis, step, lo, hi)
    labels = tuple(band_label(x) for x in target)
    if len(set(labels)) < len(labels):
        raise ValueError("the step is too fine for two-decimal band names")
    return interpolated_on(spectra, target, labels)


def interpolated_on(spectra: SpectralFrame, target: Sequence[float], labels: tuple[str, ...]) -> SpectralFrame:
    """Spectra on any ascending axis, by linear interpolation; a missing neighbour gives a missing value."""
    plan = plan_axis(spectra.axis, target)
    nodes, weights = (number_array(part) for part in zip(*plan.nodes))

    def interpolated(y: Column) -> Column:
        def value(i: Column, w: Column) -> Column:
            at = F.get(y, i)
            return missing_to_null(F.when(w == 0, at).otherwise(at + (F.get(y, i + 1) - at) * w))

        return F.when(y.isNotNull(), F.zip_with(nodes, weights, value))

    values = bound(col(spectra.column), interpolated).alias(spectra.column)
    df = spectra.df.select(*map(col, spectra.metadata), values)
    return SpectralFrame(df, plan.axis, labels, spectra.column)


def resample_table(df: DataFrame, step: float, lo: float | None = None, hi: float | None = None) -> SpectralFrame:
    """Resample an uploaded wide table: its first column is the sample ID, number-named columns are bands."""
    keep, bands = split_roles(df.columns)
    if not bands:
        raise ValueError("no spectral bands after the ID column: their names must be plain numbers")
    return resample(pack_bands(df, bands, keep), step, lo, hi)


def report(rows: int, resampled: SpectralFrame, step: float) -> dict:
    """What a resampling produced; ``rows`` comes from the caller's own count or observation."""
    axis = resampled.axis
    return {"rows": rows, "bands": len(axis), "min": axis[0], "max": axis[-1], "step": step}
