"""The overview of listed libraries and its consistency with the registry."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.names import col
from spectraloom.operators.catalog import available_types
from spectraloom.operators.filters import Between, all_of, predicate

# Displayed columns and their titles, and the overview's own word for one spectral range.
TITLES = {
    "new_code": "Dataset code",
    "description": "Description",
    "extent": "Extent",
    "sample_size": "Sample size",
    "spectral_range": "Spectral range",
}
RANGE_WORDS = {"vnir": "visnir"}


def overview_table(overview: DataFrame, titles: Mapping[str, str] = TITLES) -> DataFrame:
    """The available display columns, without repeated rows, under their titles."""
    shown = [col(c).alias(title) for c, title in titles.items() if c in overview.columns]
    if not shown:
        raise ValueError(f"the overview has no column to show; it may show {', '.join(titles)}")
    return overview.select(*shown).dropDuplicates()


def filter_overview(table: DataFrame, conditions: Mapping[str, str | Between]) -> DataFrame:
    """Column filters of the displayed table: text contained (ignoring case), or a numeric range."""
    tests = []
    for name, wanted in conditions.items():
        if isinstance(wanted, Between):
            tests.append(predicate(table, name, wanted))
        else:
            tests.append(F.lower(col(name).cast("string")).contains(wanted.lower()))
    return table.where(all_of(tests))


def missing_libraries(overview: DataFrame, registry: DataFrame, code: str = "new_code") -> DataFrame:
    """Listed libraries without any file in the registry."""
    listed = overview.select(col(code).alias("dataset_code")).where(F.col("dataset_code").isNotNull()).distinct()
    return listed.join(registry.select("dataset_code"), "dataset_code", "left_anti")


def range_mismatches(overview: DataFrame, registry: DataFrame) -> DataFrame:
    """Spectral ranges listed without a file, or with a file but not listed, per dataset in the overview."""
    words = F.transform(F.split("spectral_range", ","), lambda w: F.lower(F.trim(w)))
    listed = overview.select(F.col("new_code").alias("dataset_code"), F.explode(words).alias("spectra_type"))
    listed = listed.where(F.col("spectra_type") != "").replace(RANGE_WORDS, subset=["spectra_type"]).distinct()
    filed = available_types(registry).select("dataset_code", F.explode("spectra_types").alias("spectra_type"))
    known = overview.select(F.col("new_code").alias("dataset_code")).distinct()
    both = listed.withColumn("listed", F.lit(True)).join(
        filed.join(known, "dataset_code", "left_semi").withColumn("filed", F.lit(True)),
        ["dataset_code", "spectra_type"],
        "full",
    )
    flags = [F.coalesce(f, F.lit(False)).alias(f) for f in ("listed", "filed")]
    return both.select("dataset_code", "spectra_type", *flags).where(F.col("listed") != F.col("filed"))
