import pytest

from spectraloom.functions.names import DEFAULT_ID
from spectraloom.operators.filters import Among, Between, complete_cases, filter_site, filter_spectra
from spectraloom.operators import levels as levels_module
from spectraloom.operators.levels import level_counts, levels, site_levels
from tests import fixtures


def keys(df):
    return sorted(row[0] or "" for row in df.select(f"`{DEFAULT_ID}`").collect())


@pytest.mark.parametrize(
    ("rules", "kept"),
    [
        ({}, ["", "a", "b", "c", "d", "e", "e"]),
        ({"landuse_txt": Among(("l'Aquila",))}, ["a"]),
        ({"landuse_txt": Among(())}, ["", "a", "b", "c", "d", "e", "e"]),
        ({"irrigated_logical": Among(("true",))}, ["", "a", "d"]),
        ({"irrigated_logical": Among((True,))}, ["", "a", "d"]),
        ({"year_uint16": Among((2012, "2015"))}, ["b", "c", "e", "e"]),
        ({"year_uint16": Among((2012.0, "2015"))}, ["b", "c", "e", "e"]),
        ({"year_uint16": Among((2012.5,))}, []),
        ({"depth.upper_cm": Between(10, 20)}, ["b", "c", "e", "e"]),
        ({"depth.upper_cm": Between(lo=20)}, ["c", "e"]),
        ({"depth.upper_cm": Between(float("-inf"), 5)}, ["", "a"]),
        ({"elevation_m": Between(10.5, 100)}, ["b", "e", "e"]),
        ({DEFAULT_ID: Among(("a", "z"))}, ["a"]),
        ({"country_code": Among(("IT",)), "latitude_dd": Between(hi=42)}, ["a"]),
        ({"stale_txt": Among(("x",))}, ["", "a", "b", "c", "d", "e", "e"]),
    ],
)
def test_filter_site(spark, rules, kept):
    assert keys(filter_site(fixtures.site(spark), rules)) == kept


@pytest.mark.parametrize(
    "rules",
    [{"depth.upper_cm": Between()}, {"latitude_dd": Between(float("-inf"), float("inf"))}, {"landuse_txt": Between(1, 2)},
     {"depth.upper_cm": Among((1,))}, {"date_iso": Among(("2020-01-01",))}],
)
def test_invalid_rules(spark, rules):
    with pytest.raises(ValueError):
        filter_site(fixtures.site(spark), rules)


def test_filter_spectra(spark):
    assert keys(filter_spectra(fixtures.spectra(spark), {"instrument_txt": ("alpha",), "gone_txt": ("x",)})) == ["a", "b", "e"]


def test_complete_cases_keep_nan(spark):
    lab = fixtures.lab(spark)
    assert keys(complete_cases(lab, ["carbon_w.pct"])) == ["", "a", "a", "c", "d", "e", "x"]
    assert keys(complete_cases(lab, ["carbon_w.pct", "clay_w.pct"])) == ["", "a", "c", "d", "e", "x"]


def test_filters_reach_the_scan(spark, sf_dir, tmp_path):
    fixtures.site(spark).write.parquet(str(tmp_path / "site"))
    site = spark.read.parquet(str(tmp_path / "site"))
    plan = filter_site(site, {"country_code": Among(("IT",)), "depth.upper_cm": Between(0, 10)}).select(f"`{DEFAULT_ID}`")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(country_code,IT)" in text and "GreaterThanOrEqual(`depth.upper_cm`,0.0)" in text
    assert "landuse_txt" not in text


def test_levels_are_sorted_and_limited(spark):
    site = fixtures.site(spark)
    found = [tuple(r) for r in site_levels(site, ["country_code", "irrigated_logical", "latitude_dd", "gone_c"]).collect()]
    assert sorted(found) == [
        ("country_code", "DE"), ("country_code", "IT"), ("country_code", "US"),
        ("irrigated_logical", "false"), ("irrigated_logical", "true"),
    ]
    many = spark.range(2000).selectExpr("id AS many_id", "id % 3 AS few_id")
    found = levels(many, ["many_id", "few_id"], 500).groupBy("column").count().collect()
    assert {r["column"]: r["count"] for r in found} == {"many_id": 500, "few_id": 3}
    first = {r.level for r in levels(many, ["many_id"], 500).collect()}
    assert first == set(sorted(str(i) for i in range(2000))[:500])
    assert levels(many, [], 5).count() == 0


@pytest.mark.parametrize("limit", [1, 3, 40])
def test_first_levels_without_one_task(spark, monkeypatch, limit):
    """The way for large limits gives the same levels as the one for small limits."""
    df = spark.range(300).selectExpr("string(id % 37) AS a_txt", "id % 5 AS b_code", "cast(null as string) AS c_txt")
    small = sorted(map(tuple, levels(df, ["a_txt", "b_code", "c_txt"], limit).collect()))
    monkeypatch.setattr(levels_module, "GROUP_LIMIT", 0)
    assert sorted(map(tuple, levels(df, ["a_txt", "b_code", "c_txt"], limit).collect())) == small
    every = [("a_txt", str(i)) for i in sorted(map(str, range(37)))[:limit]] + [("b_code", str(i)) for i in range(5)][:limit]
    assert small == sorted(every)
    assert {r.column: r.levels for r in level_counts(df, ["a_txt", "b_code", "c_txt"]).collect()} == {"a_txt": 37, "b_code": 5}
