"""Checks on the inputs and counts of what each step keeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from spectraloom.functions.expressions import out_of_domain
from spectraloom.functions.names import col
from spectraloom.operators.extract import ExtractSpec, Star, extract, lab_predicate, lab_properties, site_predicate, soil_table, spectra_predicate


def key_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows. Counts combine map-side."""
    counts = df.where(col(key).isNotNull()).groupBy(col(key)).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(F.col("rows") > 1)


def domain_errors(lab: DataFrame, spec: ExtractSpec) -> DataFrame:
    """Per property: values the transformation has no result for, which become NULL."""
    names = lab_properties(lab, spec)
    counts = [F.count_if(out_of_domain(col(c), spec.transform)).alias(c) for c in names]
    pairs = [F.struct(F.lit(c).alias("property"), col(c).alias("out_of_domain")) for c in names]
    return lab.agg(*counts).select(F.inline(F.array(*pairs)))


def step_counts(star: Star, spec: ExtractSpec, joined: bool = False) -> DataFrame:
    """``(step, rows)``: rows of each table before and after its filter, by one scan of each.

    ``joined`` adds ``soil`` and ``extract``, the rows of laboratory values with sites and of the whole extract, for which
    the joins run; ``counted`` has the latter without an extra pass.
    """
    tables = {"site": ("site_filtered", star.site, site_predicate(star.site, spec)), "lab": ("lab_complete", star.lab, lab_predicate(star.lab, spec))}
    if star.spectra is not None:
        tables["spectra"] = ("spectra_filtered", star.spectra_df, spectra_predicate(star.spectra_df, spec))
    counts = []
    for step, (kept, df, test) in tables.items():
        both = df.agg(F.count(F.lit(1)).alias("all"), F.count_if(test).alias("kept"))
        rows = [F.struct(F.lit(step).alias("step"), F.col("all").alias("rows")), F.struct(F.lit(kept).alias("step"), F.col("kept").alias("rows"))]
        counts.append(both.select(F.inline(F.array(*rows))))
    if joined:
        results = {"soil": soil_table(star, spec)} | ({"extract": extract(star, spec).df} if star.spectra is not None else {})
        counts += [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(step).alias("step"), "rows") for step, df in results.items()]
    return reduce(DataFrame.unionByName, counts)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, and their number once any action has read them: no extra pass."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation
