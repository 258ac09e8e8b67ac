import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom import Among, Between, ExtractSpec, Star, extract, soil_table
from spectraloom.functions.names import DEFAULT_ID
from spectraloom.operators.extract import export_columns, find_hot_keys, output_properties
from spectraloom.operators.filters import filter_site
from spectraloom.operators.library import extract_library
from spectraloom.operators.preprocess import derivative, snv, unit_area, unit_length
from spectraloom.operators.spectra import from_array, thin
from spectraloom.plans.skew import HotKeys, SkewPolicy, add_salt, content, frequent_keys, spread, written_out
from spectraloom.sources.tables import save_bucketed
from tests import fixtures


@pytest.fixture(scope="module")
def star(spark):
    return Star(fixtures.site(spark), fixtures.lab(spark), fixtures.spectra(spark))


def values(df, *columns):
    return sorted((tuple(row) for row in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)


def test_soil_table(star):
    spec = ExtractSpec(lab=("clay_w.pct",), site=("country_code",))
    found = soil_table(star, spec)
    assert found.columns == [DEFAULT_ID, "clay_w.pct", "country_code"]
    # the site "e" is listed twice, so its one record appears twice, and no more than that
    assert values(found, DEFAULT_ID, "clay_w.pct", "country_code") == [
        ("a", 20.0, "IT"), ("b", 30.0, "IT"), ("c", 10.0, "US"), ("d", 5.0, None), ("e", 15.0, "DE"), ("e", 15.0, "DE"),
    ]


def test_soil_table_needs_a_property(star):
    with pytest.raises(ValueError, match="soil property"):
        soil_table(star, ExtractSpec(lab=()))


def test_default_property_is_the_first_by_name(star):
    assert output_properties(star.lab, ExtractSpec()) == ["carbon_w.pct"]


def test_transforms(star):
    found = soil_table(star, ExtractSpec(lab=("carbon_w.pct",), transform="sqrt"))
    rows = dict(found.where(f"`{DEFAULT_ID}` <> 'a'").distinct().collect())
    assert rows["d"] is None and rows["e"] is None and math.isnan(rows["c"])
    found = soil_table(star, ExtractSpec(lab=("carbon_w.pct",), transform="log1p"))
    assert found.columns == [DEFAULT_ID, "carbon_w.pct_log1p"]
    rows = values(found.where(f"`{DEFAULT_ID}` = 'a'"), "carbon_w.pct_log1p")
    assert rows == [(pytest.approx(math.log(2)),), (pytest.approx(math.log(3)),)]


JOIN = dict(lab=("clay_w.pct",), site=("country_code",), spectra_meta=("instrument_txt",))


def test_bands_on_the_grid(star):
    every_other = ("600", "601.9995", *[str(v) for v in range(602, 643, 2)])
    assert extract(star, ExtractSpec(**JOIN, step=2)).labels == every_other
    assert set(every_other) < set(extract(star, ExtractSpec(**JOIN)).labels)
    assert extract(star, ExtractSpec(**JOIN, step=10)).labels == ("600", "610", "620", "630", "640")
    assert extract(star, ExtractSpec(**JOIN, step=10, lo=610, hi=630)).labels == ("610", "620", "630")


@pytest.mark.parametrize(
    ("how", "expected"),
    [
        ("inner", ["a", "a", "b", "e", "e"]),
        ("left", ["a", "a", "b", "c", "d", "e", "e"]),
        ("full", ["", "a", "a", "b", "c", "d", "e", "e", "z"]),
    ],
)
def test_joins(star, how, expected):
    found = extract(star, ExtractSpec(**JOIN, how=how, step=10))
    assert sorted(row[0] or "" for row in found.df.select(f"`{DEFAULT_ID}`").collect()) == expected
    wide = found.wide()
    assert wide.columns == [DEFAULT_ID, "clay_w.pct", "country_code", "instrument_txt", "600", "610", "620", "630", "640"]
    if how != "inner":
        assert wide.where(f"`{DEFAULT_ID}` = 'c'").select("`600`").first()[0] is None


def test_spectra_filter_and_clash(spark, star):
    spectra = star.spectra.withColumn("country_code", F.lit("spectral"))
    spec = ExtractSpec(lab=("clay_w.pct",), site=("country_code",), spectra_meta=("country_code",), step=10,
                       spectra_filters={"instrument_txt": ("alpha",)}, how="full")
    found = extract(Star(star.site, star.lab, spectra), spec).df
    assert "spectral" not in {r[0] for r in found.select("country_code").collect()}
    assert found.where(f"`{DEFAULT_ID}` = 'z'").count() == 0


def test_errors(spark, star):
    with pytest.raises(ValueError, match="no key column"):
        extract(star, ExtractSpec(id_col="nothing"))
    with pytest.raises(ValueError, match="different types"):
        extract(Star(star.site.withColumn(DEFAULT_ID, F.lit(1)), star.lab, star.spectra), ExtractSpec())
    with pytest.raises(ValueError, match="unknown join"):
        extract(star, ExtractSpec(how="cross"))
    with pytest.raises(ValueError, match="unknown transformation"):
        extract(star, ExtractSpec(transform="exp"))
    with pytest.raises(ValueError, match="bound"):
        extract(star, ExtractSpec(site=("latitude_dd",)))
    extract(star, ExtractSpec(site=("latitude_dd",), site_filters={"latitude_dd": Between(hi=60)}))
    extract(star, ExtractSpec(site_filters={"country_code": Among(("IT",))}))


def test_export_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int").toDF("1000", "id", "400.5", "note")
    assert export_columns(df).columns == ["id", "note", "400.5", "1000"]
    assert export_columns(df, ["note", "gone"]).columns == ["note", "400.5", "1000"]


# ---- skew ---------------------------------------------------------------------------------------------------------


def skewed_star(spark, lab_hot, site_hot, spectra_hot):
    """Tables in which a key holds many rows on the sides given, one hot key has no partner, and NULLs abound."""

    def table(hot, n, value, partnerless):
        rows = [(k, f"{value}{k}-{i}") for k in range(10) for i in range(2)]
        rows += [(1, f"{value}h{i}") for i in range(n if hot else 0)]
        rows += [(partnerless, f"{value}p{i}") for i in range(n)]
        rows += [(None, f"{value}n{i}") for i in range(n)]
        return spark.createDataFrame(rows, f"k long, {value} string").repartition(3)

    spectra = table(spectra_hot, 30, "spec_txt", 102).withColumn("spectrum", F.array(F.lit(1.0), F.lit(2.0)))
    return Star(table(site_hot, 25, "site_txt", 101), table(lab_hot, 40, "prop", 100), from_array(spectra, [400, 402]))


@pytest.mark.parametrize("hot", [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1)])
@pytest.mark.parametrize("how", ["inner", "left", "full"])
def test_salted_join_equals_brute_force(spark, hot, how):
    star = skewed_star(spark, *hot)
    spec = ExtractSpec(lab=("prop",), site=("site_txt",), spectra_meta=("spec_txt",), id_col="k", how=how)
    spec = replace(spec, hot_keys=find_hot_keys(star, spec, SkewPolicy(partitions=0.2, min_rows=20)))
    found = extract(star, spec).df.select("k", "prop", "site_txt", "spec_txt").collect()

    lab, site = star.lab.collect(), star.site.collect()
    spectra = star.spectra.df.select("k", "spec_txt").collect()
    soil = [(a.k, a.prop, b.site_txt) for a in lab for b in site if a.k is not None and a.k == b.k]
    wanted = [(*row, c.spec_txt) for row in soil for c in spectra if row[0] == c.k]
    if how != "inner":
        keys = {c.k for c in spectra}
        wanted += [(*row, None) for row in soil if row[0] not in keys]
    if how == "full":
        keys = {row[0] for row in soil}
        wanted += [(c.k, None, None, c.spec_txt) for c in spectra if c.k not in keys]
    assert sorted(map(str, wanted)) == sorted(str(tuple(row)) for row in found)


def test_hot_keys_are_found_and_spread(spark):
    star = skewed_star(spark, True, False, False)
    hot = frequent_keys({"lab": star.lab, "site": star.site}, "k", SkewPolicy(partitions=0.2, min_rows=20))
    assert set(hot["lab"]) == {1, 100, None} and set(hot["site"]) == {101, None}
    assert frequent_keys({"lab": star.lab}, "k") == {"lab": {}}


def test_no_hot_key_is_missed_among_many_others(spark):
    """Keys with 1.5 to 20 percent of the rows, and 200 000 others that occur once or twice."""
    shares = {-1: 20, -2: 8, -3: 3, -4: 2, -5: 1.5}
    bounds, low = [], 0
    for key, share in shares.items():
        bounds.append(f"WHEN h < {low + share * 100} THEN {key}")
        low += share * 100
    df = spark.range(0, 400_000, 1, 16).withColumn("h", F.expr("pmod(xxhash64(id), 10000)"))
    df = df.withColumn("k", F.expr(f"CASE {' '.join(bounds)} ELSE id DIV 2 END"))
    hot = frequent_keys({"t": df}, "k", SkewPolicy(partitions=0.048, min_rows=1000))["t"]
    assert set(hot) == set(shares)
    assert all(abs(hot[k] - share / 100) < 0.003 for k, share in shares.items())


def test_hot_rows_land_in_many_partitions(spark):
    """A key with almost all rows: without salting all its joined rows would sit in one partition."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lab = spark.range(0, 4000, 1, 4).selectExpr("IF(id % 10 = 0, id, 7L) AS k", "id AS prop")
        site = spark.range(4000).selectExpr("id AS k", "id AS site_id")
        star = Star(site, lab)
        per_task = {}
        for name, policy in {"plain": SkewPolicy(), "salted": SkewPolicy(partitions=2, min_rows=1000)}.items():
            spec = ExtractSpec(lab=("prop",), site=("site_id",), id_col="k")
            df = soil_table(star, replace(spec, hot_keys=find_hot_keys(star, spec, policy)))
            per_task[name] = sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        assert sum(per_task["plain"]) == sum(per_task["salted"]) == 4000
        assert max(per_task["plain"]) > 3600 > 2400 > max(per_task["salted"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_shuffle_per_table(spark, sf_dir):
    """Both joins use one partitioning: each table is shuffled once, the joined soil table not again."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        star = Star(*[df.select("*") for df in (
            spark.range(50).selectExpr("id AS k", "id AS site_id"), spark.range(90).selectExpr("id % 50 AS k", "id AS prop"),
        )], from_array(spark.range(40).selectExpr("id AS k", "array(1D, 2D) AS spectrum"), [400, 402]))
        df = extract(star, ExtractSpec(lab=("prop",), site=("site_id",), id_col="k")).df
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_salted_joins_share_one_shuffle_too(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        star = Star(*[df.select("*") for df in (
            spark.range(50).selectExpr("id AS k", "id AS site_id"), spark.range(90).selectExpr("id % 50 AS k", "id AS prop"),
        )], from_array(spark.range(40).selectExpr("id AS k", "array(1D, 2D) AS spectrum"), [400, 402]))
        spec = ExtractSpec(lab=("prop",), site=("site_id",), id_col="k", hot_keys=HotKeys({"lab": {7: 0.01}, "spectra": {8: 0.01}}, (7, 8)))
        df = extract(star, spec).df
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
        assert df.count() == 80
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_tables_join_without_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, df in {
            "b_site": spark.range(50).selectExpr("id AS k", "id AS site_id"),
            "b_lab": spark.range(90).selectExpr("id % 50 AS k", "id AS prop"),
            "b_spec": spark.range(40).selectExpr("id AS k", "array(1D, 2D) AS spectrum"),
        }.items():
            save_bucketed(df, name, 4, "k")
        star = Star(spark.table("b_site"), spark.table("b_lab"), from_array(spark.table("b_spec"), [400, 402]))
        df = extract(star, ExtractSpec(lab=("prop",), site=("site_id",), id_col="k")).df
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 80
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_thinned_bands_are_read(spark, tmp_path):
    fixtures.spectra(spark).write.parquet(str(tmp_path / "spectra"))
    star = Star(fixtures.site(spark), fixtures.lab(spark), spark.read.parquet(str(tmp_path / "spectra")))
    df = extract(star, ExtractSpec(lab=("clay_w.pct",), step=10)).df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "scan_mir.610_abs" in plan and "scan_mir.612_abs" not in plan and "instrument_txt" not in plan


def test_extract_runs_no_job(spark):
    """Neither the default call nor one with known hot keys starts a job."""
    star = Star(fixtures.site(spark), fixtures.lab(spark), fixtures.spectra(spark))
    spark.sparkContext.setJobGroup("lazy", "lazy")
    try:
        extract(star, ExtractSpec(lab=("clay_w.pct",)))
        extract(star, ExtractSpec(lab=("clay_w.pct",), how="full", hot_keys=HotKeys({"lab": {"k1": 0.5}}, ("k1",))))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_salt_follows_content(spark):
    """A row has one cell however its table is dealt out."""
    df = spark.range(500).selectExpr("id % 7 AS k", "id AS prop")
    salts = [{(r.k, r.prop): r.s for r in add_salt(df.repartition(n), "s", 5).collect()} for n in (1, 3, 8)]
    assert salts[0] == salts[1] == salts[2] and len(set(salts[0].values())) == 5


def copied_star(spark):
    """Three contents make up most rows of a hot key; some rows of others, and rows without a key."""
    lab = spark.range(0, 3000, 1, 4).selectExpr("IF(id % 10 = 0, id DIV 10, 7L) AS k", "IF(id % 10 = 0, id, id % 3) AS prop", "0D AS zero")
    site = spark.range(0, 400, 1, 3).selectExpr("IF(id < 30, 7L, id) AS k", "IF(id < 30, 0L, id) AS site_n")
    spectra = spark.range(0, 300, 1, 2).selectExpr("IF(id < 5, 7L, IF(id < 90, NULL, id)) AS k", "IF(id < 90, 1, id) AS spec_n", "array(1D, id % 2D) AS spectrum")
    return Star(site, lab, from_array(spectra, [400, 402]))


@pytest.mark.parametrize("how", ["inner", "left", "full"])
def test_copies_of_hot_rows_are_counted_and_written_out(spark, how):
    star = copied_star(spark)
    spec = ExtractSpec(lab=("prop", "zero"), site=("site_n",), spectra_meta=("spec_n",), id_col="k", how=how)
    hot = replace(spec, hot_keys=find_hot_keys(star, spec, SkewPolicy(partitions=0.2, min_rows=20)))
    assert set(hot.hot_keys.repeated) == {"lab", "site"} | ({"spectra"} if how == "full" else set()) and len(hot.hot_keys.repeated["lab"]) >= 3
    found, wanted = extract(star, hot).df, extract(star, spec).df
    assert found.columns == wanted.columns
    groups = [{tuple(map(str, r[:-1])): r["count"] for r in df.groupBy(*df.columns).count().collect()} for df in (found, wanted)]
    assert groups[0] == groups[1]


def test_copies_of_a_hot_row_fill_many_cells(spark):
    """A hundred thousand copies of three rows: every cell gets its share, as counts."""
    df = spark.range(100_000).selectExpr("7L AS k", "id % 3 AS prop")
    hashes = [r[0] for r in df.select(content(df)).distinct().collect()]
    cells = spread(df, "lab", "k", {"lab": [7]}, {}, 64, {"lab": hashes})
    rows = cells.groupBy("_cell").agg(F.sum("_stands_lab").alias("n")).collect()
    assert len(rows) == 64 and sum(r.n for r in rows) == 100_000 and max(r.n for r in rows) <= 100_000 / 64 + 3
    assert cells.count() == 3 * 64 and written_out(cells.drop("_cell")).count() == 100_000


def test_names_that_differ_in_case_clash(spark):
    lab = spark.createDataFrame([(1, 2.0)], "k long, age_index double")
    site = spark.createDataFrame([(1, 9.0, "x")], "k long, AGE_INDEX double, name_txt string")
    df = soil_table(Star(site, lab), ExtractSpec(lab=("age_index",), site=("AGE_INDEX", "name_txt"), id_col="k"))
    assert df.columns == ["k", "age_index", "name_txt"] and df.select("age_index").first()[0] == 2.0


def test_arrays_must_fit_the_axis(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "k long, spectrum array<double>")
    with pytest.raises(Exception, match="a spectrum has not 2 values but 3"):
        from_array(df, [400, 402]).df.collect()
    assert from_array(df.withColumn("spectrum", F.lit(None).cast("array<double>")), [400, 402]).df.count() == 1


def test_all_bands_by_default(spark):
    df = spark.createDataFrame([(1, [0.0] * 5)], "k long, spectrum array<double>")
    spectra = from_array(df, [400, 401, 402.5, 404, 12000])
    assert thin(spectra, ["k"]).axis == (400, 401, 402.5, 404, 12000)
    assert thin(spectra, ["k"], step=2).axis == (400, 404, 12000) and thin(spectra, ["k"], lo=401, hi=404).axis == (401, 402.5, 404)


def test_typed_levels_are_pushed_down(spark, tmp_path):
    rows = [(1, 1e-4, True, "a"), (2, 1e16, False, "b"), (3, 1e7, None, "c"), (4, 123456789.0, True, "d")]
    spark.createDataFrame(rows, "n_code int, x_code double, b_logical boolean, t_txt string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for name, values, wanted in [
        ("n_code", (1, "3", "x", 2.0), [1, 3]), ("x_code", (1e-4, 1e16, 1e7, "123456789"), [1, 2, 3, 4]),
        ("b_logical", (True, "false"), [1, 2, 4]), ("t_txt", ("a", "d"), [1, 4]),
    ]:
        found = filter_site(df, {name: Among(values)})
        assert sorted(r.n_code for r in found.collect()) == wanted, name
        pushed = found._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1].split("\n")[0]
        assert name in pushed and ("In(" in pushed or "EqualTo" in pushed), pushed


def test_library_of_datasets(spark):
    def star(axis, prop):
        site = spark.createDataFrame([(1, "s")], "k long, name_txt string")
        spectra = from_array(spark.createDataFrame([(1, [float(v) for v in axis])], "k long, spectrum array<double>"), axis)
        return Star(site, spark.createDataFrame([(1, 5.0)], f"k long, {prop} double"), spectra)

    spec = ExtractSpec(lab=("clay", "sand"), site=("name_txt",), id_col="k")
    found = extract_library({"A": star([400, 405, 410], "clay"), "B": star([398, 404, 412], "sand")}, spec, step=5, lo=400, hi=410)
    rows = {r.dataset_code: r for r in found.df.collect()}
    assert found.axis == (400, 405, 410) and rows["A"].spectrum == rows["B"].spectrum == [400.0, 405.0, 410.0]
    assert rows["A"].sand is None and rows["B"].sand == 5.0


def test_preprocessing(spark):
    y = [1.0, 2.0, 4.0, -1.0]
    df = spark.createDataFrame([(1, y), (2, [3.0] * 4), (3, None), (4, [1.0, float("nan"), 2.0, 4.0])], "k long, spectrum array<double>")
    spectra = from_array(df, [400, 402, 404, 408])

    def values(method):
        return {r.k: r.spectrum for r in method(spectra).df.collect()}

    assert values(snv)[1] == pytest.approx(list((np.array(y) - np.mean(y)) / np.std(y, ddof=1)))
    assert values(snv)[2] == [None] * 4 and values(snv)[3] is None and values(snv)[4][1] is None
    assert values(unit_area)[1] == pytest.approx([0.125, 0.25, 0.5, -0.125])
    assert np.linalg.norm(values(unit_length)[1]) == pytest.approx(1)
    assert derivative(spectra).axis == (401, 403, 406) and values(derivative)[1] == [0.5, 1.0, -1.25]
