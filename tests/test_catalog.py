import json

import pytest
from pyspark.sql import functions as F

from spectraloom import ExtractSpec, extract, soil_table
from spectraloom.functions.names import DEFAULT_ID
from spectraloom.operators import catalog, checks, overview
from spectraloom.operators.extract import Star
from spectraloom.operators.filters import Between
from spectraloom.sinks.files import write_catalog
from spectraloom.sources.registry import OVERVIEW_COLUMNS, first_line, read_catalog, read_overview, read_registry, read_schemas
from spectraloom.sources.tables import column_names, read_csv_twin, read_star, register_views
from tests import fixtures


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    """Files and registry of three datasets: complete, without a laboratory file, and with unreadable files."""
    root = tmp_path_factory.mktemp("library")
    tables = {"soilsite": fixtures.site(spark), "soillab": fixtures.lab(spark), "mir": fixtures.spectra(spark)}
    for role, df in tables.items():
        df.coalesce(1).write.parquet(str(root / role))
    (root / "broken").write_text("not a table")
    small = spark.createDataFrame([(1, 2.0)], "a int, b double").toDF("note_txt", "scan_visnir.350.5_ref")
    small.write.parquet(str(root / "visnir"))
    lines = [
        ("FULL", "lib_mir_v1.csv.gz", "mir"),
        ("FULL", "lib_mir_v1.parquet", "mir"),
        ("FULL", "lib_soillab_v1.parquet", "soillab"),
        ("FULL", "lib_soillab_v0.parquet", "soilsite"),
        ("FULL", "lib_soilsite_v1.parquet", "soilsite"),
        ("FULL", "LIB_VISNIR_V1.parquet", "visnir"),
        ("FULL", "lib_visnir_v2.parquet", "broken"),
        ("FULL", "lib_notes.parquet", "mir"),
        ("PART", "lib_soilsite_v1.parquet", "soilsite"),
        ("PART", "lib_nir_v1.parquet", "mir"),
        ("BAD", "lib_soilsite_v1.parquet", "gone"),
        ("BAD", "lib_soilsite_v2.parquet", "soilsite"),
        ("BAD", "lib_mir_v1.parquet", "broken"),
        ("NAMELESS", "", "mir"),
    ]
    text = ["dataset_code,any_file,public_url"] + [f"{c},{f},{root / p}" for c, f, p in lines]
    (root / "registry.csv").write_text("\n".join(text) + "\n")
    return root


def test_registry(spark, library):
    registry = read_registry(spark, str(library / "registry.csv"))
    assert registry.columns == ["dataset_code", "file_name", "public_url", "line_no"]
    assert catalog.parquet_rows(registry).count() == 12
    assert [r[0] for r in catalog.dataset_codes(registry).collect()] == ["BAD", "FULL", "NAMELESS", "PART"]
    types = {r.dataset_code: r.spectra_types for r in catalog.available_types(registry).collect()}
    assert types == {"FULL": ["mir", "visnir"], "PART": ["nir"], "BAD": ["mir"]}
    complete = {r.dataset_code: r.complete for r in catalog.complete_datasets(registry).collect()}
    assert complete == {"FULL": True, "PART": False, "BAD": False, "NAMELESS": False}


def test_schemas_isolate_failures(spark, library):
    found = {r.public_url: r for r in read_schemas(spark, [str(library / p) for p in ("mir", "broken", "gone")]).collect()}
    assert DEFAULT_ID in found[str(library / "mir")]["columns"] and found[str(library / "mir")].error is None
    assert found[str(library / "broken")]["columns"] is None and found[str(library / "broken")].error
    assert found[str(library / "gone")].error


def test_catalog_round_trip(spark, library, tmp_path):
    documents, failed = catalog.catalog_of(spark, str(library / "registry.csv"))
    write_catalog(documents, str(tmp_path / "catalog"))
    stored = read_catalog(spark, str(tmp_path / "catalog"))
    found = {r.dataset_code: r for r in stored.collect()}
    assert set(found) == {"BAD", "FULL", "PART"}
    full = found["FULL"]
    assert full.spectra_types == ["mir", "visnir"] and set(full.files) == {"mir", "visnir", "soilsite", "soillab"}
    mir = full.files["mir"]
    assert (mir.scan_min, mir.scan_max, mir.scan_count) == (350.5, 642.0, 25)
    assert mir.meta_columns == ["instrument_txt"] and mir["columns"] is None
    assert full.files["soillab"].url == str(library / "soillab")
    assert full.files["soillab"]["columns"] == sorted(fixtures.lab(spark).columns)
    assert full.files["visnir"].url == str(library / "visnir")
    # the first site file cannot be read, and no other one takes its place
    assert found["BAD"].files == {} and found["BAD"].spectra_types == []
    assert {r.public_url for r in failed.collect()} == {str(library / "broken"), str(library / "gone")}
    assert full.generated_at.microsecond == 0
    line = next(text for p in (tmp_path / "catalog").glob("part-*") for text in p.read_text().splitlines() if "FULL" in text)
    assert json.loads(line)["files"]["mir"]["scan_count"] == 25
    assert read_catalog(spark, str(tmp_path / "nothing")) is None


def test_resolve(spark, library):
    registry = read_registry(spark, str(library / "registry.csv"))
    wanted = tuple(str(library / p) for p in ("soilsite", "soillab", "mir"))
    assert catalog.resolve(registry, "FULL", "mir") == wanted
    documents, _ = catalog.catalog_of(spark, str(library / "registry.csv"))
    assert catalog.resolve(registry, "FULL", "mir", documents) == wanted
    for code, spectra in (("PART", "nir"), ("FULL", "nir"), ("UNKNOWN", "mir")):
        with pytest.raises(LookupError):
            catalog.resolve(registry, code, spectra, documents)


def test_from_registry_to_extract(spark, library):
    registry = read_registry(spark, str(library / "registry.csv"))
    star = read_star(spark, *catalog.resolve(registry, "FULL", "mir"))
    register_views(star)
    assert spark.sql("SELECT count(*) FROM spec_view").first()[0] == 6
    found = extract(star, ExtractSpec(lab=("clay_w.pct",), step=10))
    assert found.df.count() == 5 and found.labels == ("600", "610", "620", "630", "640")
    assert column_names(spark, str(library / "visnir")) == ["note_txt", "scan_visnir.350.5_ref"]


def test_csv_twin(spark, tmp_path):
    fixtures.lab(spark).write.csv(str(tmp_path / "twin"), header=True, compression="gzip")
    assert read_csv_twin(spark, str(tmp_path / "twin")).columns == fixtures.lab(spark).columns


def overview_rows(spark, tmp_path):
    rows = [
        {"new_code": "FULL", "extent": "global", "sample_size": '"80,000+"', "spectral_range": '"vnir, mir"'},
        {"new_code": "FULL", "extent": "global", "sample_size": '"80,000+"', "spectral_range": '"vnir, mir"', "country": "X"},
        {"new_code": "PART", "extent": "national", "sample_size": "100", "spectral_range": "mir"},
        {"new_code": "LISTED", "extent": "national", "sample_size": "5", "spectral_range": "nir"},
    ]
    text = [",".join(OVERVIEW_COLUMNS)] + [",".join(r.get(c, "") for c in OVERVIEW_COLUMNS) for r in rows]
    (tmp_path / "overview.csv").write_text("\n".join(text) + "\n")
    return read_overview(spark, str(tmp_path / "overview.csv"))


def test_overview(spark, library, tmp_path):
    listed = overview_rows(spark, tmp_path)
    table = overview.overview_table(listed)
    assert table.columns == ["Dataset code", "Description", "Extent", "Sample size", "Spectral range"]
    assert table.count() == 3
    assert overview.filter_overview(table, {"Sample size": "80,000", "Extent": "GLOB"}).count() == 1
    assert overview.overview_table(listed.select("extent")).columns == ["Extent"]
    with pytest.raises(ValueError):
        overview.overview_table(listed.select("url"))
    assert read_overview(spark, str(tmp_path / "gone.csv")).count() == 0
    sizes = spark.createDataFrame([(1.0,), (5.0,)], "size double")
    assert overview.filter_overview(sizes, {"size": Between(2, 9)}).count() == 1

    registry = read_registry(spark, str(library / "registry.csv"))
    assert [r[0] for r in overview.missing_libraries(listed, registry).collect()] == ["LISTED"]
    odd = {(r.dataset_code, r.spectra_type): (r.listed, r.filed) for r in overview.range_mismatches(listed, registry).collect()}
    assert odd == {("PART", "mir"): (True, False), ("PART", "nir"): (False, True), ("LISTED", "nir"): (True, False)}


def test_checks(spark):
    star = Star(fixtures.site(spark), fixtures.lab(spark), fixtures.spectra(spark))
    assert [tuple(r) for r in checks.key_duplicates(star.site, DEFAULT_ID).collect()] == [("e", 2)]
    spec = ExtractSpec(lab=("carbon_w.pct", "clay_w.pct"), transform="log1p", spectra_filters={"instrument_txt": ("alpha",)})
    assert {tuple(r) for r in checks.domain_errors(star.lab, spec).collect()} == {("carbon_w.pct", 2), ("clay_w.pct", 0)}
    steps = {r.step: r.rows for r in checks.step_counts(star, spec).collect()}
    assert steps == {"site": 7, "site_filtered": 7, "lab": 8, "lab_complete": 6, "spectra": 6, "spectra_filtered": 3}
    df, observed = checks.counted(soil_table(star, spec), "soil")
    assert df.groupBy(F.lit(1)).count().first()[1] == observed.get["rows"]


def test_nested_catalog(spark, library, tmp_path):
    """A single document with all datasets by code is written, and read like the lines."""
    documents, _ = catalog.catalog_of(spark, str(library / "registry.csv"))
    write_catalog(documents, str(tmp_path / "nested"), nested=True)
    whole = json.loads("".join(p.read_text() for p in (tmp_path / "nested").glob("part-*")))
    assert set(whole) == {"generated_at", "datasets"} and set(whole["datasets"]["FULL"]) == {"spectra_types", "files"}
    (tmp_path / "pretty.json").write_text(json.dumps(whole, indent=2))
    write_catalog(documents, str(tmp_path / "lines"))
    lines = {r.dataset_code: (r.spectra_types, r.files) for r in read_catalog(spark, str(tmp_path / "lines")).collect()}
    for path in ("nested", "pretty.json"):
        assert {r.dataset_code: (r.spectra_types, r.files) for r in read_catalog(spark, str(tmp_path / path)).collect()} == lines
    (tmp_path / "other.json").write_text('{"a": 1}')
    with pytest.raises(ValueError, match="no catalog"):
        read_catalog(spark, str(tmp_path / "other.json"))


def test_schemas_in_batches(spark, library, tmp_path):
    urls = [str(library / p) for p in ("mir", "broken", "soillab", "gone")]
    kept = str(tmp_path / "schemas")
    read_schemas(spark, urls[:2], batch=1, into=kept)
    found = {r.public_url: r for r in read_schemas(spark, urls, batch=2, into=kept).collect()}
    plain = {r.public_url: r for r in read_schemas(spark, urls).collect()}
    assert {u: r["columns"] for u, r in found.items()} == {u: r["columns"] for u, r in plain.items()}
    assert {u for u, r in found.items() if r.error} == {urls[1], urls[3]}


def test_messages():
    assert first_line(KeyError()) == "KeyError" and first_line(ValueError("a\nb")) == "a"
