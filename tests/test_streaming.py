"""The stateless operators on an unbounded table: spectra that keep arriving, joined with fixed soil tables."""

from pyspark.sql import functions as F

from spectraloom import Among, ExtractSpec, Star, extract, resample
from spectraloom.functions.names import DEFAULT_ID
from spectraloom.operators.filters import filter_site
from tests import fixtures


def drained(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_extract_and_resample_arriving_spectra(spark, tmp_path):
    fixtures.spectra(spark).write.parquet(str(tmp_path / "spectra"))
    at_rest = spark.read.parquet(str(tmp_path / "spectra"))
    arriving = spark.readStream.schema(at_rest.schema).parquet(str(tmp_path / "spectra"))
    spec = ExtractSpec(lab=("clay_w.pct",), transform="sqrt", site=("country_code",), step=2, lo=600, hi=640,
                       spectra_filters={"instrument_txt": ("alpha",)})
    results = []
    for spectra in (at_rest, arriving):
        star = Star(fixtures.site(spark), fixtures.lab(spark), spectra)
        found = resample(extract(star, spec), 10).wide()
        results.append(drained(found, "extracted") if spectra.isStreaming else found)
    assert sorted(map(str, results[0].collect())) == sorted(map(str, results[1].collect()))
    assert results[0].count() == 4


def test_site_filter_on_arriving_sites(spark, tmp_path):
    site = fixtures.site(spark)
    site.write.parquet(str(tmp_path / "site"))
    arriving = spark.readStream.schema(site.schema).parquet(str(tmp_path / "site"))
    kept = drained(filter_site(arriving, {"country_code": Among(("IT",))}).select(F.col(f"`{DEFAULT_ID}`").alias("id")), "kept")
    assert sorted(r.id for r in kept.collect()) == ["a", "b"]
