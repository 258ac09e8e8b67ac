"""

The test tables stand in for a spectral library: customers are sites, orders are laboratory records, embeddings are
spectra on the axis 400, 402.5, ... 557.5; parts are registry lines and lineitems the columns of the registered files.
Each query gives these tables the names the operators go by, runs the operator over the whole of them, and gives the
result plain column names again.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import replace
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle_models
import oracle_queries
from spectraloom.functions.names import DEFAULT_ID, band_label, col, scan_bands
from spectraloom.operators import baseline, catalog, checks, components, correction, overview, preprocess, profile, regression, sampling, smoothing
from spectraloom.operators.extract import ExtractSpec, Star, export_columns, extract, find_hot_keys, select_lab, select_site, select_spectra, soil_table
from spectraloom.operators.filters import Among, Between
from spectraloom.operators.levels import level_counts, site_levels, spectra_levels
from spectraloom.operators.library import extract_library
from spectraloom.operators.resample import resample, resample_table
from spectraloom.operators.spectra import SpectralFrame, from_array
from spectraloom.plans.skew import SkewPolicy
from spectraloom.session import tune

BANDS = 64
AXIS = [400 + 2.5 * i for i in range(BANDS)]
ORIGIN = "1992-01-01"


class Tables:
    """The driver's tables, and the roles they play here."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def site(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias(DEFAULT_ID),
            F.col("c_name").alias("name_txt"),
            F.col("c_nationkey").alias("nation_code"),
            F.col("c_acctbal").alias("balance_m"),
            F.col("c_mktsegment").alias("segment_txt"),
        )

    def lab(self, key: str = "o_custkey") -> DataFrame:
        """Two properties with gaps, and the order number as a third."""
        days = F.datediff("o_orderdate", F.lit(ORIGIN)).cast("double")
        return self.orders.select(
            F.expr(key).alias(DEFAULT_ID),
            F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price_w.usd"),
            F.when(F.col("o_orderpriority") != "5-LOW", days).alias("age_index"),
            F.col("o_orderkey").alias("order_n"),
        )

    def spectra(self, key: str = "vec_id") -> SpectralFrame:
        df = self.embeddings.select(F.expr(key).alias(DEFAULT_ID), F.col("label").alias("instrument_txt"), F.col("embedding").alias("spectrum"))
        return from_array(df, AXIS)

    def gappy(self) -> SpectralFrame:
        """Spectra whose values below -0.1 are missing: NULL above -0.2, NaN at or below."""
        spectra = self.spectra()
        gap = F.transform("spectrum", lambda x: F.when(x >= -0.1, x).when(x <= -0.2, F.lit(float("nan"))))
        return spectra.with_df(spectra.df.withColumn("spectrum", gap))

    def wide(self, descending: bool = False) -> DataFrame:
        """Spectra as a file has them: one column per band."""
        bands = [F.get("embedding", F.lit(i)).alias(f"scan_mir.{band_label(v)}_abs") for i, v in enumerate(AXIS)]
        meta = F.col("label").alias("instrument_txt")
        return self.embeddings.select(F.col("vec_id").alias(DEFAULT_ID), *(bands[::-1] if descending else bands), meta)

    def star(self) -> Star:
        return Star(self.site(), self.lab(), self.spectra())

    def registry(self) -> DataFrame:
        size = F.col("p_size")
        kind = (
            F.when(size <= 9, "mir").when(size <= 18, "visnir").when(size <= 24, "NIR").when(size <= 36, "soillab")
            .when(size <= 48, "soilsite").otherwise("notes")
        )
        ending = F.when(F.col("p_type") == "PROMO", ".csv.gz").otherwise(".parquet")
        name = F.concat(F.lit("lib_"), kind, F.lit("_v"), size.cast("string"), ending)
        return self.part.select(
            F.col("p_brand").alias("dataset_code"),
            F.when(F.col("p_type") != "SMALL", name).alias("file_name"),
            F.concat_ws("/", F.lit("store"), "p_brand", F.col("p_partkey").cast("string")).alias("public_url"),
            F.col("p_partkey").alias("line_no"),
        )

    def file_columns(self) -> DataFrame:
        """Column names of the registered files: bands, identifiers, descriptive columns and misnamed bands."""
        number = (400 + 2.5 * F.col("l_quantity")).cast("string")
        tail = F.when(F.col("l_returnflag") == "A", "_abs").when(F.col("l_returnflag") == "R", "_ref").otherwise("_bc.abs")
        line = F.col("l_linenumber")
        name = (
            F.when(line == 1, "id.scan_local_c")
            .when(line == 2, F.concat(F.lower("l_linestatus"), F.lit("_"), F.lower("l_returnflag"), F.lit("_txt")))
            .when(line == 3, F.concat(F.lit("scan_mir.bad"), tail))
            .otherwise(F.concat(F.lit("scan_mir."), number, tail))
        )
        url = F.concat_ws("/", F.lit("store"), "p_brand", F.col("p_partkey").cast("string"))
        joined = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        return joined.select(url.alias("public_url"), name.alias("column")).distinct()

    def readable_files(self) -> DataFrame:
        """The registered files that have columns."""
        url = F.concat_ws("/", F.lit("store"), "p_brand", F.col("p_partkey").cast("string"))
        listed = self.lineitem.select(F.col("l_partkey").alias("p_partkey")).distinct()
        return self.part.join(listed, "p_partkey").select(url.alias("public_url"))

    def library_overview(self) -> DataFrame:
        """Regions and nations as listed libraries."""
        joined = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        ranges = F.when(F.col("n_regionkey") == 0, "mir").when(F.col("n_regionkey") <= 2, "vnir, mir").otherwise("nir")
        return joined.select(
            F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 3).cast("string")).alias("new_code"),
            F.col("r_name").alias("extent"),
            ranges.alias("spectral_range"),
            F.col("n_name").alias("country"),
        )


# ---- helpers for plain results ------------------------------------------------------------------------------------


def plain(df: DataFrame) -> DataFrame:
    """Result columns without dots: the key as ``id``, ``price_w.usd`` as ``price_w_usd``."""
    return df.select(*[col(c).alias("id" if c == DEFAULT_ID else c.replace(".", "_")) for c in df.columns])


def long(spectra: SpectralFrame, *keep: str, digits: int | None = None) -> DataFrame:
    """One row per band: kept columns, ``band`` and ``value``."""
    axis = F.array(*map(F.lit, spectra.axis))
    rows = spectra.df.select(*map(col, keep), F.posexplode_outer(col(spectra.column)).alias("pos", "value"))
    rows = rows.where(F.col("pos").isNotNull())
    value = F.col("value") if digits is None else F.bround("value", digits)
    return plain(rows.select(*map(col, keep), F.get(axis, F.col("pos")).alias("band"), value.alias("value")))


def wide(spectra: SpectralFrame) -> DataFrame:
    """One column ``b...`` per band."""
    table = plain(spectra.wide())
    numbers = {label: "b" + label.replace(".", "_") for label in spectra.labels}
    return table.withColumnsRenamed({k.replace(".", "_"): v for k, v in numbers.items()})


def joined(df: DataFrame, *arrays: str) -> DataFrame:
    return df.select(*[F.array_join(c, ",").alias(c) if c in arrays else F.col(c) for c in df.columns])


# ---- queries ------------------------------------------------------------------------------------------------------


def catalog_first_url(t: Tables) -> DataFrame:
    return catalog.first_url(t.registry())


def catalog_band_range(t: Tables) -> DataFrame:
    return catalog.describe_columns(t.file_columns(), "public_url").select("public_url", "scan_min", "scan_max", "scan_count")


def catalog_column_lists(t: Tables) -> DataFrame:
    described = catalog.describe_columns(t.file_columns(), "public_url")
    return joined(described.select("public_url", "columns", "meta_columns"), "columns", "meta_columns")


def catalog_build(t: Tables) -> DataFrame:
    built = joined(catalog.build_catalog(t.registry(), t.file_columns(), t.readable_files()), "columns", "meta_columns")
    return built.withColumn("scan_count", F.col("scan_count").cast("double"))


def catalog_documents(t: Tables) -> DataFrame:
    registry = t.registry()
    documents = catalog.documents(registry, catalog.build_catalog(registry, t.file_columns(), t.readable_files()))
    roles = F.array_join(F.array_sort(F.map_keys("files")), ",")
    bands = F.aggregate(F.map_values("files"), F.lit(0).cast("long"), lambda n, f: n + F.coalesce(f["scan_count"], F.lit(0)))
    types = F.array_join("spectra_types", ",")
    return documents.select("dataset_code", types.alias("spectra_types"), roles.alias("roles"), bands.alias("bands"))


def site_in_range(t: Tables) -> DataFrame:
    rules = {"segment_txt": Among(("BUILDING", "MACHINERY")), "balance_m": Between(0, 5000), "nation_code": Among((1, 2, 3, 5, 8, 13))}
    return plain(select_site(t.site(), ExtractSpec(site=tuple(rules), site_filters=rules)))


def site_lower_bound(t: Tables) -> DataFrame:
    rules = {"balance_m": Between(lo=2500, hi=float("inf"))}
    return plain(select_site(t.site(), ExtractSpec(site=("balance_m", "name_txt"), site_filters=rules)))


def lab_selected(t: Tables, transform: str) -> DataFrame:
    lab = plain(select_lab(t.lab(), ExtractSpec(lab=("price_w.usd", "age_index", "order_n"), transform=transform)))
    if transform == "none":
        return lab
    return lab.select(*[F.bround(c, 8).alias(c) if c != "id" else F.col(c) for c in lab.columns])


def lab_out_of_domain(t: Tables) -> DataFrame:
    """Account balances go below zero, where neither transformation has a result."""
    balance = t.customer.select(F.col("c_custkey").alias(DEFAULT_ID), F.col("c_acctbal").alias("balance_m"))
    out = [select_lab(balance, ExtractSpec(lab=("balance_m",), transform=f)) for f in ("sqrt", "log1p")]
    both = plain(out[0].join(out[1], DEFAULT_ID))
    return both.select("id", *[F.bround(c, 8).alias(c) for c in both.columns if c != "id"])


def domain_errors(t: Tables) -> DataFrame:
    balance = t.customer.select(F.col("c_custkey").alias(DEFAULT_ID), F.col("c_acctbal").alias("balance_m"))
    return checks.domain_errors(balance, ExtractSpec(lab=("balance_m",), transform="log1p"))


def spec_meta_filter(t: Tables) -> DataFrame:
    spec = ExtractSpec(spectra_meta=("instrument_txt",), spectra_filters={"instrument_txt": (1, 4, 7)})
    return long(select_spectra(t.spectra(), spec), DEFAULT_ID, "instrument_txt")


def band_range_thin(t: Tables) -> DataFrame:
    return wide(select_spectra(t.wide(), ExtractSpec(lo=420, hi=530, step=10)))


def export_projection(t: Tables) -> DataFrame:
    """A wide extract whose bands come first and unordered; bands are written last and ascending."""
    spec = ExtractSpec(spectra_meta=("instrument_txt",))
    table = select_spectra(t.wide(descending=True), spec).wide()
    shuffled = table.select(*map(col, reversed(table.columns)))
    exported = plain(export_columns(shuffled, [DEFAULT_ID, "instrument_txt"]))
    return exported.withColumnsRenamed({c: f"b{c}" for c in exported.columns if c[0].isdigit()})


SOIL = ExtractSpec(lab=("price_w.usd", "order_n"), site=("segment_txt", "balance_m"), site_filters={"balance_m": Between(lo=0)})


def soil_preview(t: Tables) -> DataFrame:
    return plain(soil_table(t.star(), SOIL))


def soil_name_clash(t: Tables) -> DataFrame:
    """Both tables have a column of one name: the laboratory's is kept."""
    site = t.site().withColumn("age_index", F.lit(-1.0))
    spec = ExtractSpec(lab=("age_index", "order_n"), site=("age_index", "segment_txt"))
    return plain(soil_table(Star(site, t.lab()), spec))


def extract_spec(how: str, **changes) -> ExtractSpec:
    options = dict(lab=SOIL.lab, site=SOIL.site, site_filters=SOIL.site_filters, spectra_meta=("instrument_txt",), how=how)
    return ExtractSpec(**{**options, **changes})


def as_numbers(df: DataFrame) -> DataFrame:
    """Integers that an outer join can leave empty, as doubles."""
    return df.withColumns({c: F.col(c).cast("double") for c in ("order_n", "instrument_txt")})


def extract_joined(t: Tables, how: str) -> DataFrame:
    return as_numbers(wide(extract(t.star(), extract_spec(how))))


def extract_wide_file(t: Tables) -> DataFrame:
    """Spectra as a wide file instead of packed, spectra filter included."""
    spec = extract_spec("inner", transform="sqrt", spectra_filters={"instrument_txt": (0, 2, 9)})
    result = as_numbers(wide(extract(Star(t.site(), t.lab(), t.wide()), spec)).withColumnsRenamed({"order_n_sqrt": "order_n"}))
    return result.withColumns({c: F.bround(c, 8) for c in ("price_w_usd_sqrt", "order_n")})


# A third of the laboratory rows get one key. In the tests' small tables a hundred rows count as hot.
HOT_LAB = "case when o_orderstatus = 'F' then 7L else o_custkey end"
HOT_SPECTRA = "case when label <= 2 then 8L else vec_id end"
NO_SPECTRA = "case when label <= 2 then null else vec_id end"
SALTED = SkewPolicy(partitions=0.1, min_rows=100)


def spread_extract(star: Star, spec: ExtractSpec, policy: SkewPolicy = SALTED) -> DataFrame:
    """An extract whose hot keys are looked for and spread."""
    return as_numbers(wide(extract(star, replace(spec, hot_keys=find_hot_keys(star, spec, policy)))))


def extract_hot_lab(t: Tables, how: str) -> DataFrame:
    return spread_extract(Star(t.site(), t.lab(HOT_LAB), t.spectra()), extract_spec(how))


def extract_hot_default(t: Tables) -> DataFrame:
    """With the default policy, which leaves tables this small alone."""
    return spread_extract(Star(t.site(), t.lab(HOT_LAB), t.spectra()), extract_spec("inner"), SkewPolicy())


def extract_hot_spectra(t: Tables, how: str) -> DataFrame:
    return spread_extract(Star(t.site(), t.lab(HOT_LAB), t.spectra(HOT_SPECTRA)), extract_spec(how))


def extract_null_keys(t: Tables) -> DataFrame:
    """A third of the spectra have no key: the full join keeps them all, each by itself."""
    found = spread_extract(Star(t.site(), t.lab(HOT_LAB), t.spectra(NO_SPECTRA)), extract_spec("full"))
    return found.withColumn("id", F.col("id").cast("double"))


def extract_shuffled(t: Tables) -> DataFrame:
    """Tables that come out of a shuffle, hot keys spread."""
    star = Star(t.site().repartition(3), t.lab(HOT_LAB).repartition(5, "order_n"), t.spectra(HOT_SPECTRA))
    return spread_extract(star, extract_spec("full"))


def site_typed_levels(t: Tables) -> DataFrame:
    """Levels of integer, double and boolean columns, given as numbers and as text."""
    site = t.site().withColumns({"owes_logical": F.col("balance_m") < 0, "share_code": F.col("nation_code") / 8})
    rules = {"nation_code": Among((1, "2", 3, 5, 8, 13, 40)), "owes_logical": Among((False,)), "share_code": Among((0.125, 0.25, "0.625", 1.0, "none"))}
    return plain(select_site(site, ExtractSpec(site=("nation_code", "owes_logical", "share_code", "balance_m"), site_filters={**rules, "balance_m": Between(lo=-1e9)})))


def lab_default_property(t: Tables) -> DataFrame:
    """Without a choice the first property by name is taken."""
    return plain(select_lab(t.lab(), ExtractSpec()))


def site_stale_selection(t: Tables) -> DataFrame:
    """Selections and rules on columns the dataset lacks are ignored."""
    rules = {"segment_txt": Among(("BUILDING",)), "gone_txt": Among(("x",)), "depth.upper_cm": Between(hi=20)}
    return plain(select_site(t.site(), ExtractSpec(site=("segment_txt", "gone_txt", "name_txt"), site_filters=rules)))


def sample_extract(t: Tables) -> DataFrame:
    """A sample of a sample of an extract."""
    found = plain(soil_table(t.star(), SOIL))
    half = sampling.sample(found, pct=50, identity=["order_n"])
    return sampling.sample(half, pct=10, by="segment_txt", identity=["order_n"])


def extract_many(t: Tables) -> DataFrame:
    """Two datasets, one with spectra on a coarser axis, in one extract on a common axis."""
    spectra = t.spectra()
    coarse = spectra.take(range(0, BANDS, 2))
    even = Star(t.site(), t.lab().where("order_n % 2 = 0"), spectra)
    odd = Star(t.site().drop("segment_txt"), t.lab().where("order_n % 2 = 1"), coarse)
    found = extract_library({"EVEN": even, "ODD": odd}, extract_spec("inner"), step=10, lo=400, hi=550)
    return rounded(as_numbers(wide(found)))


def preprocessed(t: Tables, method: Callable[[SpectralFrame], SpectralFrame]) -> DataFrame:
    return long(method(t.spectra()), DEFAULT_ID, digits=6)


def pca_loadings(t: Tables) -> DataFrame:
    """Three components of all spectra, with what they explain."""
    spectra = t.spectra()
    return rounded(components.loadings_table(spectra, components.fit_components(spectra, 3)), 6)


def component_scores(spectra: SpectralFrame, count: int) -> DataFrame:
    found = components.scores(spectra, components.fit_components(spectra, count))
    return rounded(plain(found.select(col(DEFAULT_ID), *[F.get("scores", F.lit(k)).alias(f"score_{k + 1}") for k in range(count)])), 6)


def pca_missing(t: Tables) -> DataFrame:
    """Components of the spectra without gaps, and no scores for the others."""
    spectra = t.spectra()
    gaps = F.when(col(DEFAULT_ID) % 10 == 0, F.transform("spectrum", lambda x, i: F.when(i != 3, x)))
    gaps = gaps.when(col(DEFAULT_ID) % 10 != 1, F.col("spectrum"))
    return component_scores(spectra.with_df(spectra.df.withColumn("spectrum", gaps)), 2)


def pca_outliers(t: Tables) -> DataFrame:
    """Score and residual distances of all spectra, and which go beyond what 97.5 % of ordinary ones stay within."""
    spectra = t.spectra()
    return rounded(plain(components.outliers(spectra, components.fit_components(spectra, 3))), 6)


def property_of_spectra(t: Tables) -> SpectralFrame:
    """The instrument's number as the property to predict; two in fifty spectra have none."""
    spectra, place = t.spectra(), col(DEFAULT_ID) % 50
    known = F.when(place == 8, F.lit(float("nan"))).when(place != 7, F.col("instrument_txt").cast("double"))
    return spectra.with_df(spectra.df.withColumn("number_index", known))


def pls_predict(t: Tables) -> DataFrame:
    spectra = property_of_spectra(t)
    model = regression.fit_regression(spectra, "number_index", 3)
    return rounded(plain(regression.predict(spectra, model).select(col(DEFAULT_ID), "predicted")), 6)


def pls_importance(t: Tables) -> DataFrame:
    spectra = property_of_spectra(t)
    return rounded(regression.importance_table(spectra, regression.fit_regression(spectra, "number_index", 3)), 6)


def pls_cross_validation(t: Tables) -> DataFrame:
    """Four folds by the remainder of the key, one to three components."""
    return rounded(regression.cross_validate(property_of_spectra(t), "number_index", 3, col(DEFAULT_ID) % 4), 6)


def preprocess_scatter(t: Tables) -> DataFrame:
    spectra = t.spectra()
    return long(correction.correct_scatter(spectra, correction.learn_scatter(spectra)), DEFAULT_ID, digits=6)


def preprocess_scaled(t: Tables) -> DataFrame:
    """Two-pass scaling of the bands of spectra with gaps."""
    spectra = t.gappy()
    return long(correction.scale_bands(spectra, correction.learn_scale(spectra)), DEFAULT_ID, digits=6)


def trimmed_tails(t: Tables) -> DataFrame:
    """Noise and signal of every band, and which bands at the ends are dropped."""
    return rounded(correction.trim_tails(t.spectra(), least=1.02)[1], 6)


def overview_filter(t: Tables) -> DataFrame:
    table = overview.overview_table(t.library_overview(), {"extent": "extent", "spectral_range": "ranges"})
    return overview.filter_overview(table, {"ranges": "MIR", "extent": "a"})


def preview_rows(t: Tables) -> DataFrame:
    """The first ten parts by key, ten columns at most, fractions rounded."""
    return profile.preview(t.part.withColumn("third", F.col("p_retailprice") / 3), order_by="p_partkey")


def summary_stats(t: Tables) -> DataFrame:
    lab = t.lab()
    return profile.summary_stats(plain(select_lab(lab, ExtractSpec(lab=("price_w.usd", "age_index")))), ["price_w_usd", "age_index"])


def summary_stats_many(t: Tables) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag"]
    return profile.summary_stats(t.lineitem, columns)


def summary_stats_missing(t: Tables) -> DataFrame:
    """NULL, NaN, a constant, an empty property and one with very few values."""
    value = F.col("value")
    return profile.summary_stats(
        t.events.select(
            F.when(value >= 20, value).when(value >= 10, F.lit(float("nan"))).alias("gappy"),
            F.lit(6.5).alias("constant"),
            F.when(value < 0, value).alias("empty"),
            F.when(F.col("event_id") < 3, value).alias("three"),
            F.when(F.col("event_id") < 2, value).alias("two"),
        ),
        ["gappy", "constant", "empty", "three", "two"],
    )


def summary_stats_extract(t: Tables) -> DataFrame:
    """The properties of an extract, under their transformed names."""
    spec = extract_spec("inner", transform="log1p")
    found = extract(t.star(), spec).df
    return profile.summary_stats(plain(found), ["price_w_usd_log1p", "order_n_log1p"])


def summary_stats_brackets(t: Tables) -> DataFrame:
    """Few values are ranked, so that quartiles are looked for inside brackets as they are in large tables."""
    return profile.summary_stats(t.lineitem, ["l_extendedprice", "l_quantity"], ranked=200)


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    doubles = {name for name, kind in df.dtypes if kind == "double"}
    return df.select(*[F.bround(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


def band_profile(t: Tables) -> DataFrame:
    return rounded(profile.band_profile(t.spectra()))


def band_profile_missing(t: Tables) -> DataFrame:
    return rounded(profile.band_profile(t.gappy()))


def band_profile_extract(t: Tables) -> DataFrame:
    """The profile of an extract: spectra count once per joined row."""
    return rounded(profile.band_profile(extract(t.star(), extract_spec("left"))))


def band_extent(t: Tables) -> DataFrame:
    return rounded(profile.profile_extent(profile.band_profile(t.spectra())))


def sample_n(t: Tables) -> DataFrame:
    return sampling.sample(t.customer, n=200, identity=["c_custkey"])


def sample_pct(t: Tables) -> DataFrame:
    return sampling.sample(t.orders, pct=12.5, identity=["o_orderkey"])


def sample_stratified(t: Tables) -> DataFrame:
    return sampling.sample(t.customer, n=333, by="c_mktsegment", identity=["c_custkey"])


def sample_stratified_pct(t: Tables) -> DataFrame:
    """Documents by source; documents in English have no group and are left out."""
    source = F.when(F.col("lang") != "en", F.col("source"))
    documents = t.documents.select("doc_id", "text", "lang", "n_chars", source.alias("source_c"))
    return sampling.sample(documents, pct=20, by="source_c", identity=["doc_id"])


def sample_copies(t: Tables) -> DataFrame:
    """Rows that are copies of few distinct ones: the quota ends inside a group of copies."""
    return sampling.sample(t.orders.select("o_orderstatus", "o_orderpriority"), pct=30)


def sample_copies_stratified(t: Tables) -> DataFrame:
    return sampling.sample(t.orders.select("o_orderstatus", "o_orderpriority"), pct=30, by="o_orderstatus")


def sample_hot_group(t: Tables) -> DataFrame:
    """Two thirds of the rows in one group."""
    group = F.when(F.col("o_orderstatus") != "F", F.lit("hot")).otherwise(F.col("o_orderpriority"))
    return sampling.sample(t.orders.withColumn("group_c", group), pct=10, by="group_c", identity=["o_orderkey"])


def resample_linear(t: Tables) -> DataFrame:
    return long(resample(t.spectra(), 2), DEFAULT_ID, digits=8)


def resample_extrapolate(t: Tables) -> DataFrame:
    return long(resample(t.spectra(), 10, lo=390, hi=570), DEFAULT_ID, "instrument_txt", digits=8)


def resample_gaps(t: Tables) -> DataFrame:
    return long(resample(t.gappy(), 2, lo=401), DEFAULT_ID, digits=8)


def resample_descending(t: Tables) -> DataFrame:
    """An uploaded table: ID first, then bands from high to low, metadata last."""
    upload = t.wide(descending=True)
    upload = upload.withColumnsRenamed({band.column: band.label for band in scan_bands(upload.columns)})
    return rounded(wide(resample_table(upload, 10, lo=405)))


def resample_extract(t: Tables) -> DataFrame:
    """An extract at full resolution, brought to a common axis."""
    spectra = select_spectra(t.spectra(), ExtractSpec())
    return long(resample(spectra, 10), DEFAULT_ID, digits=8)


def step_counts(t: Tables) -> DataFrame:
    return checks.step_counts(t.star(), extract_spec("inner", spectra_filters={"instrument_txt": (1, 2)}), joined=True)


def entry(spark: SparkSession) -> DataFrame:
    """The flagship query: sites, laboratory records and spectra joined, on sf0.001."""
    return extract_joined(Tables(spark, "/root/testdata/sf0.001"), "inner")


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "catalog_codes": lambda t: catalog.dataset_codes(catalog.parquet_rows(t.registry())),
    "catalog_parquet_rows": lambda t: catalog.parquet_rows(t.registry()),
    "catalog_roles": lambda t: catalog.classified(t.registry()).select("public_url", "role"),
    "catalog_first_url": catalog_first_url,
    "catalog_types": lambda t: joined(catalog.available_types(t.registry()), "spectra_types"),
    "catalog_complete": lambda t: catalog.complete_datasets(t.registry()),
    "catalog_resolve": lambda t: catalog.resolve_all(t.registry()),
    "catalog_band_names": lambda t: catalog.band_names(t.file_columns()),
    "catalog_band_range": catalog_band_range,
    "catalog_column_lists": catalog_column_lists,
    "catalog_build": catalog_build,
    "catalog_documents": catalog_documents,
    "overview_project": lambda t: overview.overview_table(t.library_overview(), {"extent": "extent", "spectral_range": "ranges"}),
    "overview_filter": overview_filter,
    "missing_libraries": lambda t: overview.missing_libraries(t.library_overview(), t.registry()),
    "range_mismatches": lambda t: overview.range_mismatches(t.library_overview(), t.registry()),
    "site_in_range": site_in_range,
    "site_lower_bound": site_lower_bound,
    "site_levels": lambda t: site_levels(t.site(), ["segment_txt", "name_txt", "nation_code", "balance_m"]),
    "spec_levels": lambda t: spectra_levels(t.documents, ["lang", "source", "n_chars"]),
    "lab_complete_case": partial(lab_selected, transform="none"),
    "lab_log1p": partial(lab_selected, transform="log1p"),
    "lab_sqrt": partial(lab_selected, transform="sqrt"),
    "lab_out_of_domain": lab_out_of_domain,
    "domain_errors": domain_errors,
    "spec_meta_filter": spec_meta_filter,
    "band_range_thin": band_range_thin,
    "export_projection": export_projection,
    "preview_rows": preview_rows,
    "soil_preview": soil_preview,
    "soil_name_clash": soil_name_clash,
    "extract_inner": partial(extract_joined, how="inner"),
    "extract_full": partial(extract_joined, how="full"),
    "extract_left": partial(extract_joined, how="left"),
    "extract_wide_file": extract_wide_file,
    "site_levels_first": lambda t: site_levels(t.site(), ["segment_txt", "name_txt", "nation_code"], limit=7),
    "level_counts": lambda t: level_counts(t.documents, ["lang", "source", "n_chars"]),
    "site_typed_levels": site_typed_levels,
    "site_stale_selection": site_stale_selection,
    "lab_default_property": lab_default_property,
    "extract_many": extract_many,
    "extract_shuffled": extract_shuffled,
    "extract_hot_default": extract_hot_default,
    "sample_extract": sample_extract,
    "preprocess_snv": partial(preprocessed, method=preprocess.snv),
    "preprocess_area": partial(preprocessed, method=preprocess.unit_area),
    "preprocess_derivative": partial(preprocessed, method=preprocess.derivative),
    "preprocess_length": partial(preprocessed, method=preprocess.unit_length),
    "preprocess_smooth": partial(preprocessed, method=partial(smoothing.savitzky_golay, width=7, degree=2)),
    "preprocess_slope": partial(preprocessed, method=partial(smoothing.savitzky_golay, width=9, degree=2, order=1)),
    "preprocess_spikes": partial(preprocessed, method=partial(smoothing.without_spikes, width=7, threshold=1.5)),
    "preprocess_baseline": partial(preprocessed, method=baseline.without_baseline),
    "preprocess_scatter": preprocess_scatter,
    "preprocess_scaled": preprocess_scaled,
    "trimmed_tails": trimmed_tails,
    "pca_loadings": pca_loadings,
    "pca_scores": lambda t: component_scores(t.spectra(), 3),
    "pca_missing": pca_missing,
    "pca_outliers": pca_outliers,
    "pls_predict": pls_predict,
    "pls_importance": pls_importance,
    "pls_cross_validation": pls_cross_validation,
    "extract_hot_lab_inner": partial(extract_hot_lab, how="inner"),
    "extract_hot_lab_full": partial(extract_hot_lab, how="full"),
    "extract_hot_spectra_left": partial(extract_hot_spectra, how="left"),
    "extract_hot_spectra_full": partial(extract_hot_spectra, how="full"),
    "extract_null_keys": extract_null_keys,
    "step_counts": step_counts,
    "key_duplicates": lambda t: checks.key_duplicates(t.orders, "o_custkey"),
    "summary_stats": summary_stats,
    "summary_stats_many": summary_stats_many,
    "summary_stats_missing": summary_stats_missing,
    "summary_stats_extract": summary_stats_extract,
    "summary_stats_brackets": summary_stats_brackets,
    "band_profile": band_profile,
    "band_profile_missing": band_profile_missing,
    "band_profile_extract": band_profile_extract,
    "band_extent": band_extent,
    "sample_n": sample_n,
    "sample_pct": sample_pct,
    "sample_stratified": sample_stratified,
    "sample_stratified_pct": sample_stratified_pct,
    "sample_copies": sample_copies,
    "sample_copies_stratified": sample_copies_stratified,
    "sample_hot_group": sample_hot_group,
    "resample_linear": resample_linear,
    "resample_extrapolate": resample_extrapolate,
    "resample_gaps": resample_gaps,
    "resample_descending": resample_descending,
    "resample_extract": resample_extract,
}


try:
    import corpus_pipeline
    from spectraloom.llm import queries as llm
except ModuleNotFoundError as error:  # the folder of training-data operators may be left out
    if error.name not in {"corpus_pipeline", "spectraloom.llm"}:
        raise
    llm = corpus_pipeline = None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: query(Tables(spark, folder))

    found = {name: runner(query) for name, query in QUERIES.items()}
    return found | (llm.QUERIES | {"pipeline": corpus_pipeline.run} if llm else {})


def oracle_sql() -> dict[str, str]:
    found = oracle_queries.oracle_sql() | oracle_models.oracle_sql()
    if llm:
        found |= llm.SQL
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
