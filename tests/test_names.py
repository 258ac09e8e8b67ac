import pytest
from pyspark.sql import functions as F

from spectraloom.functions import names


@pytest.mark.parametrize(
    ("name", "family"),
    [
        ("id.layer_local_c", "levels"), ("landuse_txt", "levels"), ("year_uint16", "levels"), ("site_id", "levels"),
        ("irrigated_logical", "levels"), ("country_code", "levels"), ("depth.upper_cm", "range"), ("latitude_dd", "range"),
        ("elevation_m", "range"), ("date_iso", "plain"), ("clay_w.pct", "plain"),
    ],
)
def test_column_family(name, family):
    assert names.column_family(name) == family


@pytest.mark.parametrize(
    ("name", "value"),
    [
        ("400", 400.0), ("402.5", 402.5), ("1e3", 1000.0), (".5", 0.5), ("7.", 7.0), ("-3", -3.0), ("nan", None),
        ("inf", None), ("1_000", None), (" 400 ", None), ("1d", None), ("", None), ("1e999", None), ("note", None),
    ],
)
def test_band_value(name, value):
    assert names.band_value(name) == value


SCAN_NAMES = {
    "scan_mir.600_abs": 600.0, "scan_mir.642_bc.abs": 642.0, "scan_visnir.350.5_ref": 350.5, "scan_mir.bad_abs": None,
    "scan_600": None, "other.600_abs": None, "scan_mir.nan_abs": None, "scan_mir.1d_abs": None, "scan_a.b.7_abs": None,
}


def test_scan_bands():
    found = {band.column: band.value for band in names.scan_bands(SCAN_NAMES)}
    assert found == {name: value for name, value in SCAN_NAMES.items() if value is not None}


def test_scan_value_as_expression(spark):
    rows = spark.createDataFrame([(n,) for n in SCAN_NAMES], "name string")
    found = {r.name: r.value for r in rows.select("name", names.scan_value(F.col("name")).alias("value")).collect()}
    assert found == SCAN_NAMES


def test_scan_metadata():
    columns = ["id.layer_local_c", "id.scan_local_c", "id.layer_uuid_c", "id.layer_uuid", "scan_mir.600_abs", "b_txt", "a_id"]
    assert names.scan_metadata(columns) == ["a_id", "b_txt"]


@pytest.mark.parametrize(("value", "label"), [(400.0, "400"), (402.5, "402.5"), (400.25, "400.25"), (400.126, "400.13"), (0.1, "0.1")])
def test_band_label(value, label):
    assert names.band_label(value) == label


def test_names_that_differ_in_case_only():
    names.check_names(["a", "b"])
    with pytest.raises(ValueError, match="told apart"):
        names.check_names(["Clay", "clay"])


def test_awkward_names_round_trip(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("id.layer_local_c", "600", "a`b")
    assert df.select(*map(names.col, df.columns)).columns == df.columns
