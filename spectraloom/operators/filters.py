"""Row filters chosen by column family, and their validation."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions.names import col, column_family


@dataclass(frozen=True)
class Among:
    """Keep rows whose value is one of ``values``; no values keep all rows.

    Values are read as the column's type: the text ``"3"`` and the fraction ``3.0`` are the number 3 in a column of integers. One
    that can't be read so, such as ``3.5`` there, matches nothing.
    """

    values: tuple = ()


@dataclass(frozen=True)
class Between:
    """Keep rows with ``lo <= value <= hi``; None or an infinite bound leaves that end open."""

    lo: float | None = None
    hi: float | None = None

    def bounds(self) -> tuple[float | None, float | None]:
        return tuple(None if b is None or math.isinf(b) else float(b) for b in (self.lo, self.hi))


Filter = Among | Between


def all_of(predicates: Iterable[Column]) -> Column:
    return reduce(and_, predicates, F.lit(True))


def present(wanted: Iterable[str], df: DataFrame) -> list[str]:
    """The wanted columns the table really has, each once: stale selections are ignored."""
    have = set(df.columns)
    return [c for c in dict.fromkeys(wanted) if c in have]


def as_text(value: object, kind: T.DataType) -> str:
    """A level as Spark's own cast to string renders it; a whole number written as a fraction fits whole-number columns."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and isinstance(kind, T.IntegralType):
        return str(int(value))
    return str(value)


def predicate(df: DataFrame, name: str, rule: Filter) -> Column:
    if isinstance(rule, Among):
        if not rule.values:
            return F.lit(True)
        # Literals of the column's own type, so that the scan can test them.
        kind = df.schema[name].dataType
        return col(name).isin([F.lit(as_text(v, kind)).try_cast(kind) for v in rule.values if v is not None])
    lo, hi = rule.bounds()
    x = col(name).cast("double")
    return all_of(([x >= lo] if lo is not None else []) + ([x <= hi] if hi is not None else []))


def validate_site_filters(selected: Iterable[str], rules: Mapping[str, Filter]) -> None:
    """A selected range column needs a bound; a rule must fit its column's family."""
    for name in selected:
        rule, family = rules.get(name), column_family(name)
        if family == "range" and not (isinstance(rule, Between) and rule.bounds() != (None, None)):
            raise ValueError(f"the range column {name!r} is selected without a finite bound")
        if family == "levels" and isinstance(rule, Between):
            raise ValueError(f"{name!r} is categorical: filter it by levels")
        if family == "plain" and rule is not None:
            raise ValueError(f"{name!r} cannot be filtered: its name has no known suffix")


def site_test(site: DataFrame, rules: Mapping[str, Filter]) -> Column:
    """Conjunction of the site rules; rules on absent columns are ignored."""
    names = present(rules, site)
    validate_site_filters(names, rules)
    return all_of(predicate(site, n, rules[n]) for n in names)


def spectra_test(spectra: DataFrame, levels: Mapping[str, tuple]) -> Column:
    """Level filters on spectral metadata, whatever the column's suffix."""
    return all_of(predicate(spectra, n, Among(tuple(levels[n]))) for n in present(levels, spectra))


def complete(lab: DataFrame, properties: Iterable[str]) -> Column:
    """Every selected property is recorded. NaN is recorded, NULL is not."""
    return all_of(col(c).isNotNull() for c in present(properties, lab))


def filter_site(site: DataFrame, rules: Mapping[str, Filter]) -> DataFrame:
    return site.where(site_test(site, rules))


def filter_spectra(spectra: DataFrame, levels: Mapping[str, tuple]) -> DataFrame:
    return spectra.where(spectra_test(spectra, levels))


def complete_cases(lab: DataFrame, properties: Iterable[str]) -> DataFrame:
    return lab.where(complete(lab, properties))
