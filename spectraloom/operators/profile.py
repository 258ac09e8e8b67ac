"""Summary statistics of properties and per-band profiles of spectra."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions.expressions import missing_to_null, round_half_even, sample_kurtosis, sample_skewness
from spectraloom.functions.names import col, number_array
from spectraloom.operators.filters import present
from spectraloom.operators.spectra import SpectralFrame

# Layout and rounding of the summary table.
STATISTICS = ("count", "min", "mean", "std", "median", "iqr", "max", "skewness", "kurtosis")
DECIMALS = 4

QUARTILES = (0.25, 0.5, 0.75)
# Bins a bracket is cut into, and the distinct values of a bracket that are ranked.
BINS = 1024
RANKED = 100_000
MOST = sys.float_info.max


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns statistics apply to: numbers, not booleans, dates or text."""
    return [c for c in present(columns, df) if isinstance(df.schema[c].dataType, T.NumericType)]


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(property, value)`` with properties by position and missing values left out."""
    pairs = [F.struct(F.lit(i).alias("property"), missing_to_null(col(c).cast("double")).alias("value")) for i, c in enumerate(columns)]
    return df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())


def _moments(values: DataFrame) -> list[dict]:
    """One row per property."""
    x, group = F.col("value"), values.groupBy("property")
    moments = group.agg(
        F.count(x).alias("count"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.max(x).alias("max"), sample_skewness(x).alias("skewness"), sample_kurtosis(x).alias("kurtosis"),
    )
    return moments.toArrow().to_pylist()


class Target:
    """An order statistic of a property, looked for inside a bracket: ``below`` values are smaller than all in it."""

    def __init__(self, row: dict, rank: int):
        self.property, self.rank, self.below, self.inside = row["property"], rank, 0, row["count"]
        self.lo, self.hi = row["min"], row["max"]

    @property
    def bracket(self) -> tuple[float, float]:
        return self.lo, self.hi

    def finished(self, ranked: int) -> bool:
        return self.lo == self.hi or self.inside <= ranked

    def narrow(self, bins: list[dict]) -> None:
        """``bins``: number, smallest and largest value of the bracket's occupied bins, ascending."""
        for found in bins:
            if self.rank < self.below + found["n"]:
                self.lo, self.hi, self.inside = found["lo"], found["hi"], found["n"]
                return
            self.below += found["n"]
        raise ValueError("the values changed from one read to the next: store them first")


def _targets(values: DataFrame, moments: list[dict], ranked: int) -> dict[int, list[tuple[float, float]]]:
    """Brackets by property, ascending, that hold the order statistics of the quartiles and at most ``ranked`` values each,
    or one value however often.

    A bracket with more is cut into ``BINS`` equal bins, which are counted; the one with the wanted rank is the next
    bracket. Each round is one aggregation, after which at most six times ``BINS`` rows per property come to the driver.
    """
    targets = [Target(row, rank(p * (row["count"] - 1))) for row in moments for p in QUARTILES for rank in (math.floor, math.ceil)]
    x = F.col("value")
    while wide := [t for t in targets if not t.finished(ranked)]:
        brackets = sorted({(t.property, *t.bracket) for t in wide})
        pairs = []
        for number, (place, lo, hi) in enumerate(brackets):
            # Halves first: the width of all doubles is no double. Infinite ends have bins of their own.
            low, high = (max(lo, -MOST), min(hi, MOST))
            width = high / 2 - low / 2
            at = F.least(F.lit(BINS - 1), F.floor((x / 2 - low / 2) / (width or 1.0) * BINS))
            at = F.when(x < low, -1).when(x > high, BINS).otherwise(at).cast("int")
            inside = (F.col("property") == place) & (x >= lo) & (x <= hi)
            pairs.append((inside, F.struct(F.lit(number).alias("bracket"), at.alias("bin"))))
        hit = F.coalesce(*[F.when(inside, struct) for inside, struct in pairs])
        counted = values.select("value", hit.alias("hit")).where(F.col("hit").isNotNull()).groupBy("hit.bracket", "hit.bin")
        counted = counted.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).toArrow().to_pylist()
        found: dict[tuple, list[dict]] = {}
        for row in sorted(counted, key=lambda r: (r["bracket"], r["bin"])):
            found.setdefault(brackets[row["bracket"]], []).append(row)
        for t in wide:
            t.narrow(found[(t.property, *t.bracket)])
    return {row["property"]: sorted({t.bracket for t in targets if t.property == row["property"]}) for row in moments}


def _quartiles(values: DataFrame, moments: list[dict], size: int) -> DataFrame:
    """Exact quartiles by linear interpolation between order statistics, one row per property.

    The brackets' ends cut the values into zones that follow each other. Between brackets a zone is only counted,
    inside them each distinct value is: what is ranked is a small fraction of a large group, and a value that repeats
    is one row.
    """
    value, place = F.col("value"), F.col("property")
    by_property = {row["property"]: row for row in moments}

    def constant(numbers) -> Column:
        """A number per property, looked up by the row's property."""
        return F.get(number_array([float(numbers(by_property[i])) if i in by_property else 0.0 for i in range(size)]), place)

    zone, inside = F.lit(0), F.lit(False)
    for k in range(max(len(row["brackets"]) for row in moments)):
        lo = constant(lambda row, k=k: row["brackets"][min(k, len(row["brackets"]) - 1)][0])
        hi = constant(lambda row, k=k: row["brackets"][min(k, len(row["brackets"]) - 1)][1])
        zone = zone + (value >= lo).cast("int") + (value > hi).cast("int")
        inside = inside | ((value >= lo) & (value <= hi))
    counted = values.groupBy("property", zone.alias("zone"), F.when(inside, value).alias("value"))
    counted = counted.agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("property").orderBy("zone", "value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("after", F.sum("n").over(so_far)).withColumn("before", F.col("after") - F.col("n"))

    def order_statistic(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("after")), value))

    statistics, results = [], []
    for p, name in zip(QUARTILES, ("q25", "median", "q75")):
        rank = constant(lambda row: p * (row["count"] - 1))
        statistics += [order_statistic(F.floor(rank)).alias(f"{name}_a"), order_statistic(F.ceil(rank)).alias(f"{name}_b")]
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        results.append((a + (b - a) * (rank - F.floor(rank))).alias(name))
    return ranked.groupBy("property").agg(*statistics).select("property", *results)


def summary_stats(df: DataFrame, columns: Sequence[str], ranked: int = RANKED) -> DataFrame:
    """One row per numeric property in the order given, rounded; missing values are left out.

    All quantiles are exact. The columns asked for are read here for the moments, and in tables with more than ``ranked``
    values to narrow down where the quartiles lie (a bounded number of counts per property comes to the driver), and again
    for the quartiles when the result is used. When the input is expensive to compute, pass it through
    ``plans.lineage.cut`` first.
    """
    names = numeric_columns(df, columns)
    if not names:
        raise ValueError(f"no numbers in any of {list(columns)}")
    values = _long(df, names)
    moments = {row["property"]: row for row in _moments(values)}
    brackets = _targets(values, list(moments.values()), ranked)
    for place, row in moments.items():
        row["brackets"] = brackets[place]
    measures = ("min", "mean", "std", "max", "skewness", "kurtosis")
    rows = [
        (i, name, moments[i]["count"], *[moments[i][m] for m in measures]) if i in moments
        else (i, name, 0, *[None for _ in measures])
        for i, name in enumerate(names)
    ]
    schema = pa.schema(
        [("_position", pa.int32()), ("property", pa.string()), ("count", pa.int64()), *[(m, pa.float64()) for m in measures]]
    )
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    summary = df.sparkSession.createDataFrame(table)
    if moments:
        quartiles = _quartiles(values, list(moments.values()), len(names)).withColumnRenamed("property", "_position")
        summary = summary.join(quartiles, "_position", "left")
    else:
        summary = summary.withColumns({q: F.lit(None).cast("double") for q in ("q25", "median", "q75")})
    summary = summary.withColumn("iqr", F.col("q75") - F.col("q25"))
    # As many rows as columns were asked for. The shuffle keeps the work before it in its own, parallel stage.
    summary = summary.repartition(1).sortWithinPartitions("_position")
    rounded = [round_half_even(F.col(s), DECIMALS).alias(s) if s != "count" else F.col(s) for s in STATISTICS]
    return summary.select("property", *rounded)


def band_profile(spectra: SpectralFrame) -> DataFrame:
    """Per band: number of values, mean, population SD and the mean +- SD envelope; missing values are left out.

    Exploding positions and combining per band map-side keeps the shuffle at bands x tasks rows. One aggregate per band
    column would cost far more in planning and code generation than in reading.
    """
    x = missing_to_null(F.col("value"))
    # The outer form, because for the inner one the optimizer adds a filter that computes the spectrum a second time.
    exploded = spectra.df.select(F.posexplode_outer(col(spectra.column)).alias("pos", "value"))
    exploded = exploded.where(F.col("pos").isNotNull())
    profile = exploded.groupBy("pos").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))
    axis = number_array(spectra.axis)
    return profile.select(
        F.get(axis, F.col("pos")).alias("band"),
        "n",
        "mean",
        "sd",
        (F.col("mean") - F.col("sd")).alias("lower"),
        (F.col("mean") + F.col("sd")).alias("upper"),
    )


def profile_extent(profile: DataFrame) -> DataFrame:
    """Axis and value ranges a drawing of the profile needs: one row."""
    return profile.agg(
        F.count(F.lit(1)).alias("bands"), F.min("band").alias("x_min"), F.max("band").alias("x_max"),
        F.min(F.least("lower", "upper")).alias("y_min"), F.max(F.greatest("lower", "upper")).alias("y_max"),
    )


def preview(df: DataFrame, rows: int = 10, columns: int = 10, decimals: int = 5, order_by: str | None = None) -> DataFrame:
    """The first rows and columns with fractions rounded; a limit, or a top-k when an order is given."""
    head = df.orderBy(col(order_by)).limit(rows) if order_by else df.limit(rows)
    fractions = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FractionalType, T.DecimalType))}
    return head.select(
        *[round_half_even(col(c).cast("double"), decimals).alias(c) if c in fractions else col(c) for c in df.columns[:columns]]
    )
