"""The extract: filtered sites x complete laboratory cases x thinned spectra."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.expressions import TRANSFORMS, transformed
from spectraloom.functions.names import DEFAULT_ID, check_names, clashing, col, numeric_bands, scan_metadata
from spectraloom.operators.filters import (
    Filter,
    complete,
    complete_cases,
    filter_site,
    filter_spectra,
    present,
    site_test,
    spectra_test,
    validate_site_filters,
)
from spectraloom.operators.spectra import SpectralFrame, thin
from spectraloom.plans.skew import CELL, HotKeys, SkewPolicy, drop_unpaired, frequent_copies, frequent_keys, present_keys, salt_count, spread, written_out

JOINS = ("inner", "full", "left")


@dataclass(frozen=True)
class Star:
    """The three linked tables of a dataset. Spectra may be wide or already packed."""

    site: DataFrame
    lab: DataFrame
    spectra: DataFrame | SpectralFrame | None = None

    @property
    def spectra_df(self) -> DataFrame:
        return self.spectra.df if isinstance(self.spectra, SpectralFrame) else self.spectra


@dataclass(frozen=True)
class ExtractSpec:
    """What to extract.

    ``lab=None`` takes the first property by name, as the default selection does. Without ``lo``, ``hi`` and ``step`` all
    bands are kept. ``hot_keys`` are join keys that hold a large share of a table, as ``find_hot_keys`` finds them; without
    them the joins are Spark's own.
    """

    lab: tuple[str, ...] | None = None
    transform: str = "none"
    site: tuple[str, ...] = ()
    site_filters: Mapping[str, Filter] = field(default_factory=dict)
    spectra_meta: tuple[str, ...] = ()
    spectra_filters: Mapping[str, tuple] = field(default_factory=dict)
    lo: float | None = None
    hi: float | None = None
    step: float | None = None
    how: str = "inner"
    id_col: str = DEFAULT_ID
    hot_keys: HotKeys | None = None


def _check(star: Star, spec: ExtractSpec, with_spectra: bool) -> None:
    tables = [star.site, star.lab] + ([star.spectra_df] if with_spectra else [])
    for df in tables:
        check_names(df.columns)
        if spec.id_col not in df.columns:
            raise ValueError(f"no key column {spec.id_col!r} among {df.columns[:10]}")
    types = {df.schema[spec.id_col].dataType.simpleString() for df in tables}
    if len(types) > 1:
        raise ValueError(f"the key {spec.id_col!r} has different types: {sorted(types)}")
    if spec.transform not in TRANSFORMS:
        raise ValueError(f"unknown transformation {spec.transform!r}; one of {TRANSFORMS}")
    if spec.how not in JOINS:
        raise ValueError(f"unknown join {spec.how!r}; one of {JOINS}")
    validate_site_filters(present([*spec.site, *spec.site_filters], star.site), spec.site_filters)


def default_property(lab: DataFrame) -> tuple[str, ...]:
    return tuple(sorted(lab.columns)[:1])


def lab_properties(lab: DataFrame, spec: ExtractSpec) -> list[str]:
    chosen = default_property(lab) if spec.lab is None else spec.lab
    return [c for c in present(chosen, lab) if c != spec.id_col]


def output_name(name: str, transform: str) -> str:
    return name if transform == "none" else f"{name}_{transform}"


def output_properties(lab: DataFrame, spec: ExtractSpec) -> list[str]:
    """Names the selected properties have in the extract."""
    return [output_name(c, spec.transform) for c in lab_properties(lab, spec)]


def select_lab(lab: DataFrame, spec: ExtractSpec) -> DataFrame:
    """Key and properties of the complete cases, transformed and renamed on request."""
    names = lab_properties(lab, spec)
    values = [
        col(c) if spec.transform == "none" else transformed(col(c), spec.transform).alias(output_name(c, spec.transform))
        for c in names
    ]
    return complete_cases(lab, names).select(col(spec.id_col), *values)


def select_site(site: DataFrame, spec: ExtractSpec) -> DataFrame:
    """Key and selected columns of the sites that pass the filters."""
    names = [c for c in present(spec.site, site) if c != spec.id_col]
    return filter_site(site, spec.site_filters).select(col(spec.id_col), *map(col, names))


def select_spectra(spectra: DataFrame | SpectralFrame, spec: ExtractSpec) -> SpectralFrame:
    """Key, chosen metadata and the bands on the grid of the spectra that pass the filters."""
    if isinstance(spectra, SpectralFrame):
        spectra = spectra.with_df(filter_spectra(spectra.df, spec.spectra_filters))
        offered = spectra.metadata
    else:
        offered = scan_metadata(spectra.columns)
        spectra = filter_spectra(spectra, spec.spectra_filters)
    meta = [c for c in dict.fromkeys(spec.spectra_meta) if c in offered and c != spec.id_col]
    return thin(spectra, [spec.id_col, *meta], spec.lo, spec.hi, spec.step)


def site_predicate(site: DataFrame, spec: ExtractSpec) -> Column:
    return site_test(site, spec.site_filters)


def lab_predicate(lab: DataFrame, spec: ExtractSpec) -> Column:
    return complete(lab, lab_properties(lab, spec))


def spectra_predicate(spectra: DataFrame, spec: ExtractSpec) -> Column:
    return spectra_test(spectra, spec.spectra_filters)


def without_clashes(right: DataFrame, left: DataFrame, key: str) -> DataFrame:
    """Drop the right columns the left side already has, in whatever case: the left one wins."""
    taken = clashing([c for c in right.columns if c != key], left.columns)
    return right.select(*[col(c) for c in right.columns if c not in taken])


def _sides(star: Star, spec: ExtractSpec) -> tuple[DataFrame, DataFrame, SpectralFrame | None]:
    """Laboratory, site and spectra tables, filtered, each without the columns of those before."""
    lab = select_lab(star.lab, spec)
    site = without_clashes(select_site(star.site, spec), lab, spec.id_col)
    if star.spectra is None:
        return lab, site, None
    spectra = select_spectra(star.spectra, spec)
    return lab, site, spectra.with_df(without_clashes(without_clashes(spectra.df, lab, spec.id_col), site, spec.id_col))


def find_hot_keys(star: Star, spec: ExtractSpec, policy: SkewPolicy = SkewPolicy()) -> HotKeys:
    """Join keys of the filtered tables that an extract should spread, for ``ExtractSpec.hot_keys``.

    Reads the key columns once and, if any key is hot, once more to see which of these keys occur in all tables, and the rows
    of hot keys to see which occur often. Worth it for tables known to be skewed.
    """
    _check(star, spec, with_spectra=star.spectra is not None)
    lab, site, spectra = _sides(star, spec)
    tables = {"lab": lab, "site": site} | ({"spectra": spectra.df} if spectra else {})
    hot = frequent_keys(tables, spec.id_col, policy)
    for name, keys in hot.items():
        # NULL keys only matter where rows with one reach a shuffle.
        if name != "spectra" or spec.how != "full":
            keys.pop(None, None)
    every = list({k: None for keys in hot.values() for k in keys})
    # Copies along or onto the spectra's axis need partners to meet: in an outer join, only keys that are in all tables.
    matched = every if spec.how == "inner" else present_keys(list(tables.values()), spec.id_col, every)
    return HotKeys(hot, tuple(matched), frequent_copies(tables, spec.id_col, hot, policy))


def _join_soil(lab: DataFrame, site: DataFrame, on: list[str]) -> DataFrame:
    """Sites and laboratory values in one inner join that carries the site columns along."""
    return lab.join(site, on, "inner")


def soil_table(star: Star, spec: ExtractSpec) -> DataFrame:
    """Laboratory values of the filtered sites, with the site columns: the extract without spectra."""
    _check(star, spec, with_spectra=False)
    if not lab_properties(star.lab, spec):
        raise ValueError("select at least one soil property")
    key, (lab, site, _) = spec.id_col, _sides(Star(star.site, star.lab), spec)
    if not spec.hot_keys:
        return _join_soil(lab, site, [key])
    hot = {name: spec.hot_keys.by_table.get(name, {}) for name in ("lab", "site")}
    salts = salt_count(lab, hot)
    often = spec.hot_keys.repeated
    lab, site = spread(lab, "lab", key, hot, hot, salts, often), spread(site, "site", key, hot, hot, salts, often)
    return written_out(_join_soil(lab, site, [key, CELL]).drop(CELL))


def extract(star: Star, spec: ExtractSpec) -> SpectralFrame:
    """The full join of soil data and spectra.

    ``how``: ``inner`` keeps soil rows with spectra, ``full`` keeps every soil row and every spectrum, ``left`` every
    soil row. The spectrum is NULL where there is none. The call itself runs no job.
    """
    _check(star, spec, with_spectra=True)
    key, (lab, site, spectra) = spec.id_col, _sides(star, spec)
    spectral = spectra.df
    if not spec.hot_keys:
        return spectra.with_df(_join_soil(lab, site, [key]).join(spectral, key, spec.how))

    hot = {name: spec.hot_keys.by_table.get(name, {}) for name in ("lab", "site", "spectra")}
    salts, on, matched = salt_count(lab, hot), [key, CELL], spec.hot_keys.matched
    meeting = {name: [k for k in keys if k in matched] for name, keys in hot.items()}
    soil_copies = {"lab": hot["lab"], "site": hot["site"], "spectra": meeting["spectra"]}
    often = spec.hot_keys.repeated
    soil = _join_soil(
        spread(lab, "lab", key, hot, soil_copies, salts, often), spread(site, "site", key, hot, soil_copies, salts, often), on
    )
    spectral = spread(spectral, "spectra", key, hot, meeting, salts, often)
    if spec.how == "inner":
        joined = soil.join(spectral, on, "inner")
    else:
        marked = soil.withColumn("_in_soil", F.lit(True)), spectral.withColumn("_in_spectra", F.lit(True))
        joined = drop_unpaired(marked[0].join(marked[1], on, spec.how), key, matched, "_in_soil", "_in_spectra")
    return spectra.with_df(written_out(joined.drop(CELL, "_in_soil", "_in_spectra")))


def export_columns(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The export projection of a wide table: chosen descriptive columns, then every band ascending."""
    bands = [band.column for band in numeric_bands(df.columns)]
    others = [c for c in df.columns if c not in bands]
    kept = others if keep is None else [c for c in dict.fromkeys(keep) if c in others]
    return df.select(*map(col, [*kept, *bands]))
