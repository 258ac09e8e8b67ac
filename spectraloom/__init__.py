"""Preparation of spectral reference libraries as Spark DataFrame jobs."""

from spectraloom.operators.extract import ExtractSpec, Star, extract, soil_table
from spectraloom.operators.filters import Among, Between
from spectraloom.operators.profile import band_profile, summary_stats
from spectraloom.operators.resample import resample
from spectraloom.operators.sampling import sample
from spectraloom.operators.spectra import SpectralFrame, pack_bands

__all__ = [
    "Among",
    "Between",
    "ExtractSpec",
    "SpectralFrame",
    "Star",
    "band_profile",
    "extract",
    "pack_bands",
    "resample",
    "sample",
    "soil_table",
    "summary_stats",
]
