import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spectraloom.functions.names import DEFAULT_ID, scan_bands
from spectraloom.operators.resample import plan_axis, report, resample, resample_table, target_axis
from spectraloom.operators.spectra import from_array, pack_bands, split_roles, wanted
from spectraloom.sinks.files import csv_name, write_csv, write_parquet
from spectraloom.sources.tables import csv_header, read_spectra_csv
from spectraloom.streaming.uploads import resample_arrivals
from tests import fixtures


def frame(spark, axis, rows):
    data = [(i, row) for i, row in enumerate(rows)]
    return from_array(spark.createDataFrame(data, "id int, spectrum array<double>"), axis)


def spectrums(found):
    return [r.spectrum for r in found.df.orderBy("id").collect()]


def test_target_axis():
    assert target_axis([400, 410], 2) == [400, 402, 404, 406, 408, 410]
    assert target_axis([401, 410], 2) == [401, 403, 405, 407, 409]
    assert target_axis([0, 1], 10, 395, 416) == [395, 405, 415]
    for lo, hi in ((5, 5), (6, 5)):
        with pytest.raises(ValueError, match="less than"):
            target_axis([0, 1], 2, lo, hi)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    axis=st.lists(st.integers(0, 4000), min_size=2, max_size=30, unique=True).map(sorted),
    step=st.sampled_from([1, 2, 10]),
    widen=st.integers(-5, 25),
    seed=st.integers(0, 999),
)
def test_equals_numpy(spark, axis, step, widen, seed):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(3, len(axis)))
    lo, hi = axis[0] - widen, max(axis[-1] + widen, axis[0] - widen + 1)
    found = resample(frame(spark, axis, rows.tolist()), step, lo, hi)
    for got, row in zip(spectrums(found), rows):
        np.testing.assert_allclose(got, np.interp(found.axis, axis, row), rtol=1e-12, atol=1e-12)


def test_missing_neighbours(spark):
    """On a node only the node counts; between nodes a missing neighbour gives a missing value."""
    source = frame(spark, [400, 410, 420, 430], [[1.0, None, 3.0, 4.0], [1.0, math.nan, 3.0, None]])
    found = spectrums(resample(source, 5, 395, 435))
    assert found[0] == [1.0, 1.0, None, None, None, 3.0, 3.5, 4.0, 4.0]
    assert found[1] == [1.0, 1.0, None, None, None, 3.0, None, None, None]


def test_missing_spectrum_stays_missing(spark):
    assert spectrums(resample(frame(spark, [400, 410], [None, [1.0, 2.0]]), 5)) == [None, [1.0, 1.5, 2.0]]


def test_own_axis_is_identity(spark):
    rows = np.random.default_rng(1).normal(size=(4, 6)).tolist()
    assert spectrums(resample(frame(spark, [400, 402, 404, 406, 408, 410], rows), 2)) == rows


def test_plan_reads_no_neighbour_on_nodes():
    assert plan_axis([0, 10, 20], [-5, 0, 5, 10, 20, 30]).nodes == ((0, 0.0), (0, 0.0), (0, 0.5), (1, 0.0), (2, 0.0), (2, 0.0))


def test_no_shuffle_no_python(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("embedding", "spectrum")
    plan = resample(from_array(df, range(400, 464)), 2).df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("cast(embedding") == 1


def test_absolute_grid():
    assert [v for v in (599, 600, 601.9995, 602.0005, 601, 640, 641) if wanted(v, 600, 640, 2)] == [600, 601.9995, 602.0005, 640]


def test_thinning_packed_equals_thinning_columns(spark):
    spectra = fixtures.spectra(spark)
    every = scan_bands(spectra.columns)
    keep = [i for i, b in enumerate(every) if wanted(b.value, 600, 640, 10)]
    packed = pack_bands(spectra, every, [DEFAULT_ID]).take(keep)
    columns = pack_bands(spectra, [every[i] for i in keep], [DEFAULT_ID])
    assert packed.labels == columns.labels
    assert sorted(map(str, packed.df.collect())) == sorted(map(str, columns.df.collect()))


def test_two_columns_for_one_band(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "k int, a double, b double").toDF("k", "scan_mir.600_abs", "scan_nir.600_ref")
    with pytest.raises(ValueError, match="same band"):
        pack_bands(df, scan_bands(df.columns), ["k"])


# ---- uploads ------------------------------------------------------------------------------------------------------


def upload(folder, text, name="upload.csv"):
    (folder / name).write_text(text)
    return str(folder / name)


def test_roles():
    keep, bands = split_roles(["410", "note", "405", "400", "nan", "1e3"])
    assert keep == ["410", "note", "nan"] and [b.column for b in bands] == ["400", "405", "1e3"]


def test_descending_upload_with_gaps(spark, tmp_path):
    path = upload(tmp_path, 'sample,410,note,405,400\n001,3.0,"a, b",NA,1.0\n002,,x,2,1\n')
    found = resample(read_spectra_csv(spark, path), 5).wide()
    assert found.columns == ["sample", "note", "400", "405", "410"]
    assert [tuple(r) for r in found.orderBy("sample").collect()] == [("001", "a, b", 1.0, None, 3.0), ("002", "x", 1.0, 2.0, None)]


def test_metadata_types_on_request(spark, tmp_path):
    path = upload(tmp_path, "sample,n,400,402\n1,5,0.1,0.2\n2,6,0.3,0.4\n")
    assert dict(read_spectra_csv(spark, path).df.dtypes)["n"] == "string"
    assert dict(read_spectra_csv(spark, path, infer_metadata=True).df.dtypes)["n"] == "int"


def test_numeric_id_is_no_band(spark, tmp_path):
    found = read_spectra_csv(spark, upload(tmp_path, "1,400,402\n7,0.1,0.2\n"))
    assert found.metadata == ["1"] and found.axis == (400.0, 402.0)


@pytest.mark.parametrize(
    ("header", "message"),
    [("sample,a,b", "no spectral bands"), ("sample,400,400,402", "more than once"), ("sample,400,400.0", "same band"), ("s,A,a,400", "told apart")],
)
def test_bad_headers(spark, tmp_path, header, message):
    with pytest.raises(ValueError, match=message):
        read_spectra_csv(spark, upload(tmp_path, header + "\n" + "1," * header.count(",") + "1\n"))


def test_text_in_a_band_is_an_error(spark, tmp_path):
    found = read_spectra_csv(spark, upload(tmp_path, "sample,400,402\n1,0.1,oops\n"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        found.df.collect()


def test_resample_table_without_bands(spark):
    with pytest.raises(ValueError, match="no spectral bands"):
        resample_table(spark.createDataFrame([(1, 2)], "a int, b int"), 2)


def test_report(spark):
    found = resample(frame(spark, [400, 410], [[1.0, 2.0]]), 2)
    assert report(1, found, 2) == {"rows": 1, "bands": 6, "min": 400.0, "max": 410.0, "step": 2}


def test_csv_round_trip(spark, tmp_path):
    path = upload(tmp_path, "sample,site,400,402.5,405\na,x,1,,3\nb,,4,5,6\n")
    found = resample(read_spectra_csv(spark, path), 2.5)
    write_csv(found, str(tmp_path / "out"), single_file=True)
    text = "".join(p.read_text() for p in (tmp_path / "out.csv").glob("part-*"))
    assert text.splitlines() == ["sample,site,400,402.5,405", "a,x,1.0,,3.0", "b,,4.0,5.0,6.0"]
    write_csv(found, str(tmp_path / "some"), keep=["sample"])
    assert csv_header(spark, str(tmp_path / "some.csv")) == ["sample", "400", "402.5", "405"]
    write_parquet(found, str(tmp_path / "packed"))
    assert spark.read.parquet(str(tmp_path / "packed")).columns == ["sample", "site", "spectrum"]


def test_nan_is_written_empty(spark, tmp_path):
    df = spark.createDataFrame([("a", math.nan, 1), ("b", 2.5, None)], "k string, x double, n int")
    write_csv(df, str(tmp_path / "plain.csv"), single_file=True)
    text = "".join(p.read_text() for p in (tmp_path / "plain.csv").glob("part-*"))
    assert text.splitlines() == ["k,x,n", "a,,1", "b,2.5,"]


def test_text_survives_a_round_trip(spark, tmp_path):
    rows = [("a", ' padded "quoted", with comma '), ("b", "two\nlines")]
    source = from_array(spark.createDataFrame(rows, "sample string, note string").selectExpr("*", "array(1D, 2D) AS spectrum"), [400, 402])
    write_csv(source, str(tmp_path / "text"), single_file=True)
    found = read_spectra_csv(spark, str(tmp_path / "text.csv"), multi_line=True)
    assert sorted((r["sample"], r.note) for r in found.df.collect()) == rows


def test_csv_name():
    assert (csv_name("a"), csv_name("a.csv")) == ("a.csv", "a.csv")


def test_uploads_are_resampled_once_each(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    args = (spark, str(inbox), ["sample", "400", "410"], str(tmp_path / "out"), str(tmp_path / "progress"), 5)
    upload(inbox, "sample,400,410\na,1,2\n", "one.csv")
    resample_arrivals(*args).awaitTermination()
    upload(inbox, "sample,400,410\nb,3,NA\n", "two.csv")
    resample_arrivals(*args).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("sample").collect()
    assert [(r.sample, r.spectrum) for r in found] == [("a", [1.0, 1.5, 2.0]), ("b", [3.0, None, None])]


def test_kept_columns_of_a_table(spark, tmp_path):
    df = spark.createDataFrame([("x", 2.0, 1.0, "y")], "a string, `402` double, `400` double, b string")
    write_csv(df, str(tmp_path / "some.csv"), keep=["a"], single_file=True)
    assert spark.read.csv(str(tmp_path / "some.csv"), header=True).columns == ["a", "400", "402"]
    with pytest.raises(Exception, match="already exists"):
        write_csv(df, str(tmp_path / "some.csv"))
