"""Readers for the dataset registry, the library overview, file schemas and stored catalogs."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import batched

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.plans.lineage import cut, shared_folder

# The columns of the two tables, in file order.
REGISTRY_COLUMNS = ("dataset_code", "file_name", "public_url")
OVERVIEW_COLUMNS = (
    "old_code", "new_code", "description", "country", "extent", "sample_size", "sample_time", "access", "source",
    "redistribution", "license", "version_source", "version_processed", "spectral_range", "contact", "contact_email",
    "url", "relevant_publication_1", "relevant_publication_2", "relevant_publication_3", "map_url",
)

#: Files whose schemas the driver holds at a time.
SCHEMA_BATCH = 1000
SCHEMA_ROW = "public_url string, columns array<string>, error string"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Dataset -> file -> URL, with the line number. Columns go by position, whatever their header says."""
    schema = ", ".join(f"{c} string" for c in REGISTRY_COLUMNS)
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=True)
    return rows.withColumn("line_no", F.monotonically_increasing_id())


def read_overview(spark: SparkSession, path: str) -> DataFrame:
    """The library overview; quoted fields may hold commas. No file gives an empty table, any other fault is raised."""
    schema = ", ".join(f"{c} string" for c in OVERVIEW_COLUMNS)
    try:
        return spark.read.schema(schema).csv(path, header=True, escape='"')
    except AnalysisException as problem:
        if not_found(problem):
            return spark.createDataFrame([], schema)
        raise


def not_found(problem: AnalysisException) -> bool:
    return problem.getCondition() == "PATH_NOT_FOUND"


def first_line(problem: Exception) -> str:
    """A message's first line, or the kind of fault where there is no message."""
    return next(iter(str(problem).splitlines()), "") or type(problem).__name__


def read_schemas(spark: SparkSession, urls: DataFrame | Iterable[str], threads: int = 16, batch: int = SCHEMA_BATCH, into: str | None = None) -> DataFrame:
    """Column names of each Parquet file, or why they could not be read: ``public_url, columns, error``.

    ``urls`` is a table with a column of that name, or some texts. Each read is a Spark job on one footer; a file that fails
    has NULL columns and its message, and the others go on. Results are collected as Parquet files in the folder ``into``
    (default: a new one in the shared folder), a batch at a time, and that is all the driver holds; files that were read there
    before are not read again.
    """

    def names(url: str) -> tuple[str, list[str] | None, str | None]:
        try:
            return url, spark.read.parquet(url).columns, None
        except Exception as problem:  # noqa: BLE001: whatever is wrong with one file is reported with it
            return url, None, first_line(problem)

    if not isinstance(urls, DataFrame):
        urls = spark.createDataFrame([(url,) for url in urls], "public_url string")
    into = into or f"{shared_folder(spark)}/schemas-{uuid.uuid4()}"
    # The folder must be there before it is read.
    spark.createDataFrame([], SCHEMA_ROW).coalesce(1).write.mode("append").parquet(into)
    known = spark.read.schema(SCHEMA_ROW).parquet(into).where("error is null").select("public_url")
    missing = urls.select("public_url").where("public_url is not null").distinct().join(known, "public_url", "left_anti")
    with ThreadPoolExecutor(threads) as pool:
        for some in batched((row[0] for row in cut(missing).toLocalIterator()), batch):
            spark.createDataFrame(list(pool.map(names, some)), SCHEMA_ROW).coalesce(1).write.mode("append").parquet(into)
    # A file that failed once and was read later has two rows.
    rows = spark.read.schema(SCHEMA_ROW).parquet(into).groupBy("public_url").agg(F.max("columns").alias("columns"), F.min("error").alias("error"))
    return rows.withColumn("error", F.when(F.col("columns").isNull(), F.col("error")))


def read_catalog(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored catalog, or None when there is none: one JSON document per dataset, or a single one with all by code.

    Any other layout is an error.
    """
    from spectraloom.operators.catalog import DATASET_TYPE, DOCUMENT_SCHEMA

    try:
        fields = {f.name for f in spark.read.json(path, multiLine=True, samplingRatio=1.0).schema.fields}
    except AnalysisException as problem:
        if not_found(problem):
            return None
        raise
    if "dataset_code" in fields:
        return spark.read.schema(DOCUMENT_SCHEMA).json(path)
    if "datasets" not in fields:
        raise ValueError(f"{path} holds no catalog: its fields are {sorted(fields)}")
    whole = spark.read.schema(f"generated_at timestamp, datasets map<string, {DATASET_TYPE}>").json(path, multiLine=True)
    each = whole.select("generated_at", F.explode("datasets").alias("dataset_code", "dataset"))
    return each.select("dataset_code", "generated_at", "dataset.spectra_types", "dataset.files")
