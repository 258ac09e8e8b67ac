"""Readers for star tables, registries and uploaded spectra."""
