"""Writers for extracts, resampled spectra and catalogs."""
