"""Rules on column and file names.

The schema of a spectral library is dynamic: what a column means follows from its name. Names are few (a schema's
worth), so these rules run on the driver; the same band rule exists as a Column expression for catalogs, where names
are rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Naming conventions of the library files.
DEFAULT_ID = "id.layer_local_c"
ID_COLUMNS = ("id.layer_local_c", "id.scan_local_c", "id.layer_uuid_c", "id.layer_uuid")
CATEGORICAL_SUFFIXES = ("_c", "_txt", "_uint16", "_id", "_logical", "_code")
RANGE_SUFFIXES = ("_cm", "_dd", "_m")
SCAN_PREFIX = "scan_"
SCAN_HEAD = r"^scan_.*?\."
SCAN_TAIL = r"_(abs|ref|bc\.abs)$"
SPECTRA_TYPES = ("mir", "visnir", "nir")
SITE_MARK = "soilsite"
LAB_MARK = "soillab"
PARQUET_MARK = ".parquet"

# A plain finite number. Python's float() and Spark's cast both take more ("nan", "1_000", "1d").
PLAIN_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def q(name: str) -> str:
    """Quote a column name: library names hold dots and may be plain numbers."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def number_array(values: Iterable[float]) -> Column:
    """A constant array. One parsed expression: building thousands of literal columns one by one takes seconds."""

    def written(v: float) -> str:
        return str(v) if isinstance(v, int) else f"{v!r}D" if math.isfinite(v) else f"double('{v}')"

    return F.expr(f"array({', '.join(map(written, values))})")


def column_family(name: str) -> str:
    """``levels``, ``range`` or ``plain`` by the name's suffix."""
    if name.endswith(CATEGORICAL_SUFFIXES):
        return "levels"
    if name.endswith(RANGE_SUFFIXES):
        return "range"
    return "plain"


def band_value(name: str) -> float | None:
    """The number a band column is named after, or None when the name is no plain finite number."""
    if not re.match(PLAIN_NUMBER, name):
        return None
    value = float(name)
    return value if math.isfinite(value) else None


@dataclass(frozen=True)
class Band:
    column: str
    label: str
    value: float


def scan_bands(columns: Iterable[str]) -> list[Band]:
    """Bands among the ``scan_`` columns, ascending; names without a number are left out."""
    bands = []
    for column in columns:
        if column.startswith(SCAN_PREFIX):
            label = re.sub(SCAN_TAIL, "", re.sub(SCAN_HEAD, "", column))
            value = band_value(label)
            if value is not None:
                bands.append(Band(column, label, value))
    return sorted(bands, key=lambda band: band.value)


def numeric_bands(columns: Iterable[str]) -> list[Band]:
    """Columns whose whole name is a number, ascending."""
    named = ((column, band_value(column)) for column in columns)
    return sorted((Band(c, c, v) for c, v in named if v is not None), key=lambda band: band.value)


def scan_metadata(columns: Iterable[str]) -> list[str]:
    """Descriptive columns of a spectra table: neither bands nor identifiers, sorted."""
    return sorted(c for c in columns if not c.startswith(SCAN_PREFIX) and c not in ID_COLUMNS)


def scan_value(name: Column) -> Column:
    """``scan_bands`` for names held as rows: the band's number, NULL when there is none."""
    label = F.regexp_replace(F.regexp_replace(name, SCAN_HEAD, ""), SCAN_TAIL, "")
    return F.when(name.startswith(SCAN_PREFIX) & label.rlike(PLAIN_NUMBER), label.try_cast("double"))


def band_label(value: float) -> str:
    """The number with at most two decimals and no zeros at the end."""
    return np.format_float_positional(value, precision=2, unique=False, trim="-")


def clashing(columns: Iterable[str], taken: Iterable[str]) -> list[str]:
    """The columns that Spark would take for one of ``taken``: it ignores case."""
    taken = {c.lower() for c in taken}
    return [c for c in columns if c.lower() in taken]


def check_names(columns: Iterable[str]) -> None:
    """Reject names Spark cannot tell apart (its resolution ignores case)."""
    seen: dict[str, str] = {}
    for column in columns:
        other = seen.setdefault(column.lower(), column)
        if other is not column:
            raise ValueError(f"columns {other!r} and {column!r} cannot be told apart")
