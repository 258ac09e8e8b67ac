import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectraloom.functions.expressions import round_half_even
from spectraloom.operators import profile
from spectraloom.operators.profile import band_profile, numeric_columns, preview, profile_extent, summary_stats
from spectraloom.operators.spectra import from_array
from tests import fixtures

ORDER = ["count", "min", "mean", "std", "median", "iqr", "max", "skewness", "kurtosis"]


def expected(frame):
    stats = pd.DataFrame(
        {
            "count": frame.count(), "min": frame.min(), "mean": frame.mean(), "std": frame.std(), "median": frame.median(),
            "iqr": frame.quantile(0.75) - frame.quantile(0.25), "max": frame.max(), "skewness": frame.skew(),
            "kurtosis": frame.kurt(),
        }
    )
    return stats[ORDER].round(4)


def compare(spark, frame, **options):
    table = spark.createDataFrame(frame.reset_index()).drop("index")
    found = summary_stats(table, list(frame.columns), **options).toPandas()
    assert list(found["property"]) == list(frame.columns)
    found = found.set_index("property")[ORDER].astype(float)
    np.testing.assert_allclose(found.to_numpy(), expected(frame).astype(float).to_numpy(), atol=1.01e-4, rtol=0)


@pytest.fixture(scope="module")
def random_frame():
    rng = np.random.default_rng(7)
    n = 4000
    frame = pd.DataFrame(
        {
            "normal": rng.normal(5, 2, n), "lognormal": rng.lognormal(0, 1, n), "ties": rng.integers(0, 5, n).astype(float),
            "one_value_mostly": np.where(rng.random(n) < 0.9, 3.25, rng.random(n)), "constant": np.full(n, 6.5),
        }
    )
    frame["gaps"] = frame["normal"].where(rng.random(n) < 0.3)
    for k in (1, 2, 3, 4):
        frame[f"n{k}"] = frame["normal"].where(np.arange(n) < k)
    frame["same4"] = frame["constant"].where(np.arange(n) < 4)
    frame["empty"] = np.nan
    return frame


def test_summary_equals_pandas(spark, random_frame):
    compare(spark, random_frame)


@pytest.mark.parametrize("ranked", [5, 50, 200])
def test_summary_with_brackets_equals_pandas(spark, random_frame, ranked):
    """A coarse sketch: the quartiles are found inside brackets, as in large tables."""
    compare(spark, random_frame, ranked=ranked)


def test_quartiles_are_found_in_parallel(spark, random_frame):
    """Only the finished rows pass one task: nothing but an exchange lies below the final sort."""
    table = spark.createDataFrame(random_frame[["normal", "ties"]])
    lines = summary_stats(table, ["normal", "ties"])._jdf.queryExecution().executedPlan().toString().splitlines()
    sort = next(i for i, line in enumerate(lines) if "Sort [_position" in line)
    assert "Exchange SinglePartition" in lines[sort + 1] and not any("Coalesce" in line for line in lines)


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "a double, b int")
    found = summary_stats(empty, ["b", "a"]).collect()
    assert [(r.property, r["count"], r.median) for r in found] == [("b", 0, None), ("a", 0, None)]
    with pytest.raises(ValueError, match="no numbers"):
        summary_stats(fixtures.lab(spark), ["method_txt"])


def test_numeric_columns(spark):
    assert numeric_columns(fixtures.site(spark), ["year_uint16", "irrigated_logical", "date_iso", "latitude_dd", "gone"]) == [
        "year_uint16", "latitude_dd",
    ]


def test_rounding_is_that_of_numpy(spark):
    values = [0.5, 1.5, 2.5, 25.40225, 1.00015, -0.00001, 2.67495, 1e10 + 0.12345, -1.5, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(round_half_even(F.col("x"), 4).alias("r"))
    assert [r.r for r in df.collect()] == list(np.round(values, 4))


def spectral(spark, rows):
    return from_array(spark.createDataFrame(rows, "id int, spectrum array<double>"), [400, 402, 404])


def test_band_profile_equals_numpy(spark):
    nan = math.nan
    rows = [[1.0, 2.0, None], [3.0, nan, None], [5.0, 7.0, nan]]
    found = {r.band: r for r in band_profile(spectral(spark, [(i, r) for i, r in enumerate(rows)] + [(9, None)])).collect()}
    data = np.array([[nan if v is None else v for v in r] for r in rows])
    for i, band in enumerate((400.0, 402.0)):
        assert found[band].mean == pytest.approx(np.nanmean(data[:, i])) and found[band].sd == pytest.approx(np.nanstd(data[:, i]))
        assert found[band].lower == pytest.approx(found[band].mean - found[band].sd)
    assert (found[404.0].n, found[404.0].mean) == (0, None)


def test_profile_extent_skips_missing(spark):
    profile = band_profile(spectral(spark, [(1, [1.0, None, 4.0]), (2, [3.0, None, 4.0])]))
    assert tuple(profile_extent(profile).first()) == (3, 400.0, 404.0, 1.0, 4.0)


def test_band_profile_computes_spectra_once(spark):
    frame = spectral(spark, [(1, [1.0, 2.0, 3.0])])
    frame = frame.with_df(frame.df.withColumn("spectrum", F.transform("spectrum", lambda x: F.sqrt(x))))
    plan = band_profile(frame).select("mean")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SQRT") == 1


def test_preview(spark):
    df = spark.range(30).selectExpr("id", "id / 7 AS a", *[f"id AS c{i}" for i in range(12)])
    found = preview(df, order_by="id")
    assert found.count() == 10 and len(found.columns) == 10
    assert found.collect()[1]["a"] == 0.14286


def test_what_is_ranked_stays_bounded(spark):
    """However many values there are, no more than the bound of distinct ones enter a window, and quartiles stay exact."""
    for n in (2_000, 200_000):
        values = spark.range(n).selectExpr("0 AS property", "double(pmod(xxhash64(id), 1000000007)) AS value")
        moments = profile._moments(values)
        brackets = profile._targets(values, moments, ranked=50)[0]
        inside = [values.where((F.col("value") >= lo) & (F.col("value") <= hi)).distinct().count() for lo, hi in brackets]
        assert len(brackets) <= 6 and max(inside) <= 50
        table = values.select("value")
        found = summary_stats(table, ["value"], ranked=50).first()
        frame = table.toPandas()["value"]
        assert found.median == round(frame.median(), 4) and found.iqr == round(frame.quantile(0.75) - frame.quantile(0.25), 4)


def test_quartiles_of_extreme_values(spark):
    big = 1.7e308
    rows = [(float(v),) for v in [float("-inf"), -big, -1e-300, 0.0, 1e-300, 1.0, big, big, float("inf")] * 3]
    values = spark.createDataFrame(rows, "value double").selectExpr("0 AS property", "value")
    brackets = profile._targets(values, profile._moments(values), ranked=1)[0]
    assert [lo for lo, hi in brackets if lo == hi] == [lo for lo, _ in brackets]
    ordered = sorted(v for (v,) in rows)
    assert {ordered[r] for q in (0.25, 0.5, 0.75) for r in (math.floor(q * 26), math.ceil(q * 26))} == {lo for lo, _ in brackets}
