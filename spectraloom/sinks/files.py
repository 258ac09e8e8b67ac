"""Writers for extracts, resampled spectra and catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions.expressions import missing_to_null
from spectraloom.functions.names import col
from spectraloom.operators.extract import export_columns
from spectraloom.operators.spectra import SpectralFrame
from spectraloom.sources.tables import CSV_OPTIONS


def csv_name(name: str) -> str:
    return name if name.endswith(".csv") else name + ".csv"


def blank_missing(df: DataFrame) -> DataFrame:
    """NaN written as an empty field."""
    fractions = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in fractions else col(c) for c in df.columns])


def _blank_spectrum(spectra: SpectralFrame) -> SpectralFrame:
    values = F.transform(col(spectra.column), missing_to_null).alias(spectra.column)
    described = blank_missing(spectra.df.select(*map(col, spectra.metadata), col(spectra.column)))
    return spectra.with_df(described.select(*map(col, spectra.metadata), values))


def write_csv(
    data: SpectralFrame | DataFrame, path: str, keep: Sequence[str] | None = None, single_file: bool = False, mode: str = "error"
) -> None:
    """Chosen descriptive columns (default: all) and every band, ascending, as CSV with a header.

    Parallel by default: a folder of part files, each with the header. ``single_file`` puts all rows through one task
    and is meant for extracts that fit a desktop tool.
    """
    wide = _blank_spectrum(data).wide(keep) if isinstance(data, SpectralFrame) else export_columns(blank_missing(data), keep)
    wide = wide.repartition(1) if single_file else wide
    kept_as_is = {"emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    wide.write.mode(mode).csv(csv_name(path), **CSV_OPTIONS, **kept_as_is)


def write_parquet(spectra: SpectralFrame, path: str, mode: str = "error") -> None:
    """The packed form, for further Spark work."""
    spectra.df.write.mode(mode).parquet(path)


def write_catalog(documents: DataFrame, path: str, nested: bool = False, mode: str = "error") -> None:
    """One JSON document per dataset; ``nested`` writes a single one with all datasets by code, as one task's work.

    The nested document holds the catalog of a whole library in memory, so it is for exchange with programs that want it.
    """
    if not nested:
        documents.write.mode(mode).json(path)
        return
    entry = F.struct("spectra_types", "files")
    whole = documents.agg(F.max("generated_at").alias("generated_at"), F.map_from_entries(F.collect_list(F.struct("dataset_code", entry))).alias("datasets"))
    whole.write.mode(mode).option("ignoreNullFields", False).json(path)
