"""The catalog: which files a dataset has and what is in them.

The input is the registry (one row per file) and the column names of the files as rows; both grow with the number of
files, not with their contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions.names import (
    ID_COLUMNS,
    LAB_MARK,
    PARQUET_MARK,
    SCAN_PREFIX,
    SITE_MARK,
    SPECTRA_TYPES,
    scan_value,
)
from spectraloom.sources.registry import read_registry, read_schemas

FILE_TYPE = (
    "struct<url: string, columns: array<string>, scan_min: double, scan_max: double, scan_count: bigint, "
    "meta_columns: array<string>>"
)
DOCUMENT_SCHEMA = (
    f"dataset_code string, generated_at timestamp, spectra_types array<string>, files map<string, {FILE_TYPE}>"
)
DATASET_TYPE = f"struct<spectra_types: array<string>, files: map<string, {FILE_TYPE}>>"


def parquet_rows(registry: DataFrame) -> DataFrame:
    """Registry rows of Parquet files; a missing name is none."""
    return registry.where(F.coalesce(F.col("file_name").contains(PARQUET_MARK), F.lit(False)))


def dataset_codes(registry: DataFrame) -> DataFrame:
    return registry.select("dataset_code").distinct().orderBy("dataset_code")


def file_role(name: Column) -> Column:
    """Site, lab or spectra table."""
    return F.when(name.contains(SITE_MARK), SITE_MARK).when(name.contains(LAB_MARK), LAB_MARK).otherwise("spectra")


def spectra_type(name: Column) -> Column:
    """The spectral range a file name states, ignoring case; NULL when none."""
    name = F.lower(name)
    return F.coalesce(*[F.when(name.contains(f"_{t}_"), F.lit(t)) for t in SPECTRA_TYPES])


def classified(registry: DataFrame) -> DataFrame:
    """Parquet rows with their role (``soilsite``, ``soillab`` or a spectral range); others are left out."""
    name = F.col("file_name")
    role = F.when(file_role(name) == "spectra", spectra_type(name)).otherwise(file_role(name))
    return parquet_rows(registry).withColumn("role", role).where(F.col("role").isNotNull())


def first_url(registry: DataFrame) -> DataFrame:
    """The URL listed first for each dataset and role."""
    return classified(registry).groupBy("dataset_code", "role").agg(F.min_by("public_url", "line_no").alias("public_url"))


def available_types(registry: DataFrame) -> DataFrame:
    """Sorted spectral ranges per dataset, from file names alone."""
    spectra = classified(registry).where(~F.col("role").isin(SITE_MARK, LAB_MARK))
    return spectra.groupBy("dataset_code").agg(F.array_sort(F.collect_set("role")).alias("spectra_types"))


def complete_datasets(registry: DataFrame) -> DataFrame:
    """Per dataset of the registry: which of site, lab and spectra are listed, and whether all are."""
    name = F.col("file_name")
    listed = F.coalesce(name.contains(PARQUET_MARK), F.lit(False))
    spectra = (file_role(name) == "spectra") & spectra_type(name).isNotNull()

    def any_row(test: Column) -> Column:
        return F.bool_or(listed & F.coalesce(test, F.lit(False)))

    found = registry.groupBy("dataset_code").agg(
        any_row(file_role(name) == SITE_MARK).alias("has_site"), any_row(file_role(name) == LAB_MARK).alias("has_lab"), any_row(spectra).alias("has_spectra"),
    )
    return found.withColumn("complete", F.col("has_site") & F.col("has_lab") & F.col("has_spectra"))


def resolve_all(registry: DataFrame) -> DataFrame:
    """Site, lab and spectra URL of every dataset and spectral range that has all three."""
    urls = first_url(registry)
    by_role = {role: urls.where(F.col("role") == role) for role in (SITE_MARK, LAB_MARK)}
    site = by_role[SITE_MARK].select("dataset_code", F.col("public_url").alias("site_url"))
    lab = by_role[LAB_MARK].select("dataset_code", F.col("public_url").alias("lab_url"))
    spectra = urls.where(~F.col("role").isin(SITE_MARK, LAB_MARK)).select(
        "dataset_code", F.col("role").alias("spectra_type"), F.col("public_url").alias("spectra_url")
    )
    return spectra.join(site, "dataset_code").join(lab, "dataset_code")


def resolve(registry: DataFrame, code: str, spectra: str, catalog: DataFrame | None = None) -> tuple[str, str, str]:
    """The three URLs of one dataset and spectral range, from the catalog when it lists the dataset."""
    row = None
    if catalog is not None:
        url = {role: F.col("files").getItem(role)["url"] for role in (SITE_MARK, LAB_MARK, spectra)}
        row = catalog.where(F.col("dataset_code") == code).select(*url.values()).first()
    if row is None:
        chosen = (F.col("dataset_code") == code) & (F.col("spectra_type") == spectra)
        row = resolve_all(registry).where(chosen).select("site_url", "lab_url", "spectra_url").first()
    if row is None or any(v is None for v in row):
        raise LookupError(f"no complete set of files for {code!r} and {spectra!r}")
    return tuple(row)


def band_names(columns: DataFrame) -> DataFrame:
    """``band`` for each row of ``(..., column)``: the number a scan column stands for, NULL for other columns."""
    return columns.withColumn("band", scan_value(F.col("column")))


def describe_columns(columns: DataFrame, *keys: str) -> DataFrame:
    """Per key: sorted column list, band range and number, sorted descriptive columns of a spectra table."""
    name = F.col("column")
    descriptive = ~name.startswith(SCAN_PREFIX) & ~name.isin(*ID_COLUMNS)
    return band_names(columns).groupBy(*keys).agg(
        F.array_sort(F.collect_list(name)).alias("columns"),
        F.min("band").alias("scan_min"),
        F.max("band").alias("scan_max"),
        F.count("band").alias("scan_count"),
        F.array_sort(F.collect_list(F.when(descriptive, name))).alias("meta_columns"),
    )


def build_catalog(registry: DataFrame, columns: DataFrame, readable: DataFrame | None = None) -> DataFrame:
    """One row per dataset and role: ``url``, column list or band range, descriptive columns.

    ``columns`` has ``(public_url, column)`` for every readable file, ``readable`` their ``public_url`` where that is known
    without reading all columns. A role stands for the first file listed for site and lab (none, when that one is unreadable),
    and for the last readable one of a spectral range. Files are chosen first; only the columns of those are put together.
    """
    found = (columns if readable is None else readable).select("public_url").distinct().withColumn("readable", F.lit(True))
    files = classified(registry).select("dataset_code", "role", "public_url", "line_no")
    soil = F.col("role").isin(SITE_MARK, LAB_MARK)
    seen = files.join(found, "public_url", "left")
    rank = F.when(soil, -F.col("line_no")).when(F.col("readable"), F.col("line_no"))
    chosen = seen.groupBy("dataset_code", "role").agg(F.max_by(F.struct("public_url", "readable"), rank).alias("file"))
    chosen = chosen.where("file.readable").select("dataset_code", "role", F.col("file.public_url").alias("public_url"))
    described = describe_columns(columns.join(chosen, "public_url"), "dataset_code", "role", "public_url")
    return described.select(
        "dataset_code",
        "role",
        F.col("public_url").alias("url"),
        F.when(soil, F.col("columns")).alias("columns"),
        *[F.when(~soil, F.col(c)).alias(c) for c in ("scan_min", "scan_max", "scan_count", "meta_columns")],
    )


def documents(registry: DataFrame, catalog: DataFrame) -> DataFrame:
    """One nested document per dataset: spectral ranges found, files by role, time of generation (UTC seconds)."""
    details = F.struct("url", "columns", "scan_min", "scan_max", "scan_count", "meta_columns")
    spectra = F.when(~F.col("role").isin(SITE_MARK, LAB_MARK), F.col("role"))
    nested = catalog.groupBy("dataset_code").agg(
        F.array_sort(F.collect_set(spectra)).alias("spectra_types"),
        F.map_from_entries(F.collect_list(F.struct("role", details))).alias("files"),
    )
    every = parquet_rows(registry).select("dataset_code").distinct()
    return every.join(nested, "dataset_code", "left").select(
        "dataset_code",
        F.date_trunc("second", F.current_timestamp()).alias("generated_at"),
        F.coalesce("spectra_types", F.array().cast("array<string>")).alias("spectra_types"),
        F.coalesce("files", F.create_map().cast(f"map<string, {FILE_TYPE}>")).alias("files"),
    )


def catalog_of(spark: SparkSession, registry_path: str, threads: int = 16, schemas_into: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Build the catalog documents of a registry file; also returns ``(public_url, error)`` of unreadable files.

    ``schemas_into`` names a folder in which the files' column names are collected and found again (default: a new one in the
    shared folder). The driver holds one batch of files at a time.
    """
    registry = read_registry(spark, registry_path)
    schemas = read_schemas(spark, classified(registry).select("public_url"), threads, into=schemas_into)
    columns = schemas.select("public_url", F.explode("columns").alias("column"))
    readable = schemas.where(F.col("columns").isNotNull() & (F.size("columns") > 0)).select("public_url")
    failed = schemas.where(F.col("error").isNotNull()).select("public_url", "error")
    return documents(registry, build_catalog(registry, columns, readable)), failed
