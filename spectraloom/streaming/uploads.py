"""Resampling of uploaded spectra as they arrive in a folder.

The filters, projections and the resampling keep no state, so the batch operators take a streaming DataFrame as it is;
this is the one job that profits: files are resampled once each, with progress kept in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from spectraloom.operators.resample import resample
from spectraloom.operators.spectra import SpectralFrame
from spectraloom.sources.tables import CSV_OPTIONS, pack_text_bands, text_schema


def stream_spectra_csv(spark: SparkSession, folder: str, header: list[str]) -> SpectralFrame:
    """Uploads that share one header, as an unbounded table."""
    files = spark.readStream.schema(text_schema(header)).csv(folder, enforceSchema=False, **CSV_OPTIONS)
    return pack_text_bands(files)


def resample_arrivals(
    spark: SparkSession, folder: str, header: list[str], out: str, checkpoint: str, step: float,
    lo: float | None = None, hi: float | None = None,
) -> StreamingQuery:
    """Resample everything that has arrived since the last run and append it as Parquet."""
    resampled = resample(stream_spectra_csv(spark, folder, header), step, lo, hi)
    writer = resampled.df.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
