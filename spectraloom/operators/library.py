"""One extract over many datasets."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.names import check_names, col
from spectraloom.operators.extract import ExtractSpec, Star, extract
from spectraloom.operators.resample import resample
from spectraloom.operators.spectra import SpectralFrame

CODE = "dataset_code"


def extract_library(stars: Mapping[str, Star], spec: ExtractSpec, step: float, lo: float, hi: float) -> SpectralFrame:
    """The extracts of several datasets, by code, one under the other, their spectra on the axis ``lo, lo + step, ... hi``.

    Each row has its ``dataset_code``. Columns a dataset lacks are NULL there. A common axis needs both its ends given: a
    dataset whose own spectra end before holds its end values beyond.
    """
    if not stars:
        raise ValueError("give at least one dataset")
    found = [resample(extract(star, spec), step, lo, hi) for star in stars.values()]
    tables = [part.df.withColumn(CODE, F.lit(code)) for code, part in zip(stars, found)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    check_names(every.columns)
    others = [c for c in every.columns if c not in (CODE, found[0].column)]
    return replace(found[0], df=_ordered(every, [CODE, *others, found[0].column]))


def _ordered(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*map(col, columns))
