"""Distinct levels of categorical columns, for choosing filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.names import col, column_family
from spectraloom.operators.filters import present
from spectraloom.plans.lineage import cut

# From this limit on Spark keeps no more than the limit's rows of a group in each task only if told how; see ``first_levels``.
GROUP_LIMIT = 1000


def distinct_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, level)``: every distinct level of each column, as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("level")) for c in columns])
    return df.select(F.inline(pairs)).where(F.col("level").isNotNull()).distinct()


def first_levels(distinct: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` levels of each column in text order, without sorting a column in one task.

    Below Spark's own threshold for limits by group, each task passes on ``limit`` levels of a column at most. Above it,
    levels are sorted by ranges, one task each, and counts of the ranges before tell the ranks.
    """
    rank = Window.partitionBy("column").orderBy("level")
    if limit < GROUP_LIMIT:
        return distinct.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= limit).drop("_rank")
    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(distinct.repartitionByRange(partitions, "column", "level").withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("column").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as ranges and columns.
    offsets = ranges.groupBy("column", "_range").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = ranges.withColumn("_rank", F.row_number().over(Window.partitionBy("column", "_range").orderBy("level")))
    placed = within.join(offsets.where(F.col("_before") < limit), ["column", "_range"])
    return placed.where(F.col("_before") + F.col("_rank") <= limit).select("column", "level")


def levels(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """``(column, level)``: the distinct levels of each column, as text; with ``limit`` the first ones in text order.

    ``level_counts`` tells how many there are, so that a cut shows.
    """
    columns = present(columns, df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, level string")
    distinct = distinct_levels(df, columns)
    return distinct if limit is None else first_levels(distinct, limit)


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, levels)``: the number of distinct levels of each column that has any."""
    columns = present(columns, df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, levels long")
    return distinct_levels(df, columns).groupBy("column").agg(F.count("*").alias("levels"))


def site_levels(site: DataFrame, selected: Sequence[str], limit: int | None = None) -> DataFrame:
    """Levels of the selected site columns that are categorical by name."""
    return levels(site, [c for c in selected if column_family(c) == "levels"], limit)


def spectra_levels(spectra: DataFrame, selected: Sequence[str], limit: int | None = None) -> DataFrame:
    """Levels of the selected spectral metadata columns, whatever their names."""
    return levels(spectra, selected, limit)
