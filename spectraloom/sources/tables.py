"""Readers for star tables and uploaded spectra."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions.names import DEFAULT_ID, check_names, col, q
from spectraloom.operators.extract import Star
from spectraloom.operators.spectra import SpectralFrame, split_roles

# Spellings of a missing number in a text file (the defaults of the usual CSV readers).
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Quotes inside quoted fields are doubled, as spreadsheet and data frame tools write them.
CSV_OPTIONS = {"header": True, "escape": '"'}


def read_star(spark: SparkSession, site: str, lab: str, spectra: str) -> Star:
    """The three tables of a dataset, lazily: the scans later read only the columns and row groups they need."""
    return Star(*(spark.read.parquet(path) for path in (site, lab, spectra)))


def read_csv_twin(spark: SparkSession, path: str) -> DataFrame:
    """The compressed CSV twin of a Parquet file. Gzip cannot be split: prefer the Parquet file."""
    return spark.read.csv(path, inferSchema=True, **CSV_OPTIONS)


def column_names(spark: SparkSession, path: str) -> list[str]:
    """Column names of a Parquet file, from its footer."""
    return spark.read.parquet(path).columns


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The header line as it is written; Spark's reader renames duplicates."""
    line = spark.read.text(path).first()
    if line is None:
        raise ValueError(f"{path} is empty")
    names = next(csv.reader([line[0].lstrip("\ufeff")]))
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"columns occur more than once: {repeated}")
    check_names(names)
    return names


def number_or_missing(text):
    """A band value written as text: missing words are NULL, other text that is no number is an error."""
    text = F.trim(text)
    return F.when(~text.isin(*MISSING_WORDS), text.cast("double"))


def pack_text_bands(df: DataFrame, column: str = "spectrum") -> SpectralFrame:
    """Pack an uploaded table whose columns are all text; descriptive columns stay as written."""
    keep, bands = split_roles(df.columns)
    if not bands:
        raise ValueError("no spectral bands after the ID column: their names must be plain numbers")
    if len({band.value for band in bands}) < len(bands):
        raise ValueError("two columns stand for the same band")
    written = F.expr(f"array({', '.join(q(band.column) for band in bands)})")
    values = F.transform(written, number_or_missing).alias(column)
    packed = df.select(*map(col, keep), values)
    return SpectralFrame(packed, tuple(b.value for b in bands), tuple(b.label for b in bands), column)


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def read_spectra_csv(
    spark: SparkSession, path: str, infer_metadata: bool = False, multi_line: bool = False
) -> SpectralFrame:
    """An uploaded CSV: first column the sample ID, number-named columns the bands (in any order).

    Only the header is read here. Metadata stays text, which an export writes back unchanged; ``infer_metadata`` gives
    it types at the price of one more pass over the file. Fields with line breaks need ``multi_line``, which keeps a
    file from being split.
    """
    names = csv_header(spark, path)
    options = {"enforceSchema": False, "multiLine": multi_line, **CSV_OPTIONS}
    spectra = pack_text_bands(spark.read.schema(text_schema(names)).csv(path, **options))
    if not infer_metadata:
        return spectra
    keep, _ = split_roles(names)
    inferred = spark.read.csv(path, inferSchema=True, multiLine=multi_line, **CSV_OPTIONS).schema
    types = {name: inferred[i].dataType for i, name in enumerate(names)}
    typed = [col(c).cast(types[c]).alias(c) for c in keep]
    return spectra.with_df(spectra.df.select(*typed, col(spectra.column)))


def save_bucketed(df: DataFrame, table: str, buckets: int, id_col: str = DEFAULT_ID, mode: str = "error") -> None:
    """Store a star table bucketed and sorted by its key: later extracts join it without a shuffle."""
    df.write.bucketBy(buckets, id_col).sortBy(id_col).mode(mode).saveAsTable(table)


def register_views(star: Star) -> None:
    """Name the three tables for SQL."""
    star.site.createOrReplaceTempView("site_view")
    star.lab.createOrReplaceTempView("lab_view")
    if star.spectra is not None:
        star.spectra_df.createOrReplaceTempView("spec_view")



