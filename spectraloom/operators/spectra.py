"""Spectra as one array column plus a shared axis.

Wide tables (one column per band) are fine for files and bad for plans: shuffles, codegen and planning all pay per
column. Bands are therefore thinned while still columns, so the scan reads no others, then packed into one array, and
unpacked only for an export.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.names import Band, band_label, col, number_array, numeric_bands, q, scan_bands

# Fixed value: how far a band may lie off the grid.
GRID_TOLERANCE = 0.001


@dataclass(frozen=True)
class SpectralFrame:
    """Rows with a ``column ARRAY<DOUBLE>`` whose i-th value belongs to ``axis[i]`` (ascending)."""

    df: DataFrame
    axis: tuple[float, ...]
    labels: tuple[str, ...]
    column: str = "spectrum"

    @property
    def metadata(self) -> list[str]:
        return [c for c in self.df.columns if c != self.column]

    def with_df(self, df: DataFrame) -> SpectralFrame:
        return replace(self, df=df)

    def wide(self, keep: Sequence[str] | None = None) -> DataFrame:
        """Kept descriptive columns (default all), then every band ascending."""
        kept = self.metadata if keep is None else [c for c in keep if c in self.metadata]
        bands = [f"get({q(self.column)}, {i}) AS {q(label)}" for i, label in enumerate(self.labels)]
        return self.df.selectExpr(*map(q, kept), *bands)

    def take(self, positions: Sequence[int]) -> SpectralFrame:
        """Only the bands at these ascending positions."""
        if list(positions) == list(range(len(self.axis))):
            return self
        wanted = set(positions)
        mask = number_array(int(i in wanted) for i in range(len(self.axis)))
        spectrum = F.filter(col(self.column), lambda _, i: F.get(mask, i) == 1).alias(self.column)
        return replace(
            self,
            df=self.df.select(*map(col, self.metadata), spectrum),
            axis=tuple(self.axis[i] for i in positions),
            labels=tuple(self.labels[i] for i in positions),
        )


def from_array(df: DataFrame, axis: Iterable[float], column: str = "spectrum") -> SpectralFrame:
    """Adopt a table that already stores its spectra as arrays on a known ascending axis.

    A spectrum with more or fewer values than the axis is an error when it is read; a NULL one is allowed.
    """
    axis = tuple(float(v) for v in axis)
    if any(a >= b for a, b in zip(axis, axis[1:])):
        raise ValueError("the axis must ascend")
    others = [col(c) for c in df.columns if c != column]
    size = F.size(col(column))
    wrong = F.raise_error(F.concat(F.lit(f"a spectrum has not {len(axis)} values but "), size.cast("string"))).cast("array<double>")
    df = df.select(*others, F.when(size != len(axis), wrong).otherwise(col(column).cast("array<double>")).alias(column))
    return SpectralFrame(df, axis, tuple(band_label(v) for v in axis), column)


def wanted(value: float, lo: float | None, hi: float | None, step: float | None) -> bool:
    """Whether a band is asked for: within the bounds given, and near a multiple of the step where one is given."""
    if lo is not None and value < lo or hi is not None and value > hi:
        return False
    return step is None or abs(math.remainder(value, step)) < GRID_TOLERANCE


def thin_bands(bands: Iterable[Band], lo: float | None, hi: float | None, step: float | None) -> list[Band]:
    return [band for band in bands if wanted(band.value, lo, hi, step)]


def pack_bands(df: DataFrame, bands: Sequence[Band], keep: Sequence[str], column: str = "spectrum") -> SpectralFrame:
    """Turn band columns into one array. Values become doubles before any arithmetic."""
    labels = [band.label for band in bands]
    if len(set(labels)) < len(labels):
        raise ValueError("two columns stand for the same band")
    values = ", ".join(f"CAST({q(band.column)} AS DOUBLE)" for band in bands)
    packed = df.selectExpr(*map(q, keep), f"CAST(array({values}) AS ARRAY<DOUBLE>) AS {q(column)}")
    return SpectralFrame(packed, tuple(band.value for band in bands), tuple(labels), column)


def thin(
    spectra: DataFrame | SpectralFrame, keep: Sequence[str], lo: float | None = None, hi: float | None = None, step: float | None = None
) -> SpectralFrame:
    """Descriptive columns plus the bands asked for (default: all), from a wide table or a packed one."""
    if isinstance(spectra, SpectralFrame):
        kept = spectra.with_df(spectra.df.select(*map(col, keep), col(spectra.column)))
        return kept.take([i for i, v in enumerate(kept.axis) if wanted(v, lo, hi, step)])
    return pack_bands(spectra, thin_bands(scan_bands(spectra.columns), lo, hi, step), keep)


def split_roles(columns: Sequence[str]) -> tuple[list[str], list[Band]]:
    """Uploaded spectra: the first column is the sample ID, numbers are bands, the rest describes the sample."""
    bands = numeric_bands(columns[1:])
    band_columns = {band.column for band in bands}
    return [columns[0]] + [c for c in columns[1:] if c not in band_columns], bands
