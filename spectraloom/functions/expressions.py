"""Column expressions with the reference semantics for missing values and small groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSFORMS = ("none", "sqrt", "log1p")


def missing_to_null(x: Column) -> Column:
    """NaN counts as missing in every statistic."""
    return F.nanvl(x, F.lit(None).cast("double"))


def bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``x`` computed once per row.

    A lambda that refers to a computed column would compute it again for every element once the optimizer has merged
    the two projections.
    """
    return F.get(F.transform(F.array(x), body), F.lit(0))


def round_half_even(x: Column, decimals: int) -> Column:
    """Scale, round halves to even, scale back: the rounding of numeric arrays, to the last bit. No negative zero."""
    scale = F.lit(float(10**decimals))
    return F.rint(x * scale) / scale + F.lit(0.0)


def transformed(x: Column, transform: str) -> Column:
    """sqrt(x) or ln(1+x); NULL outside the domain."""
    x = x.cast("double")
    if transform == "sqrt":
        return F.when(x >= 0, F.sqrt(x))
    if transform == "log1p":
        return F.when(x > -1, F.ln(x + F.lit(1.0)))
    raise ValueError(f"unknown transformation {transform!r}; one of {TRANSFORMS}")


def out_of_domain(x: Column, transform: str) -> Column:
    """True where ``transformed`` turns a value into NULL."""
    x = x.cast("double")
    return {"sqrt": x < 0, "log1p": x <= -1}.get(transform, F.lit(False))


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness: NULL below three values, 0 for a constant."""
    n = F.count(x).cast("double")
    return (
        F.when(n < 3, F.lit(None).cast("double"))
        .when(F.min(x) == F.max(x), F.lit(0.0))
        .otherwise(F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x))
    )


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis: NULL below four values, 0 for a constant."""
    n = F.count(x).cast("double")
    return (
        F.when(n < 4, F.lit(None).cast("double"))
        .when(F.min(x) == F.max(x), F.lit(0.0))
        .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))
    )
