"""Quantiles of the normal and the chi-square distribution."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def gamma_share(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its power series; it converges for every x > 0."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = 0
    while term > total * 1e-17:
        k += 1
        term *= x / (a + k)
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi_square_quantile(p: float, freedom: float) -> float:
    """By bisection, to the last digits."""
    if not 0 < p < 1 or freedom <= 0:
        raise ValueError("a share between 0 and 1 and a positive number of degrees of freedom are needed")
    lo, hi = 0.0, max(1.0, freedom)
    while gamma_share(freedom / 2, hi / 2) < p:
        lo, hi = hi, 2 * hi
    for _ in range(200):
        middle = (lo + hi) / 2
        if not lo < middle < hi:
            break
        lo, hi = (middle, hi) if gamma_share(freedom / 2, middle / 2) < p else (lo, middle)
    return (lo + hi) / 2


def cube_root_quantile(p: float, freedom: float) -> float:
    """The chi-square quantile by the cube-root normal approximation, for any positive degrees of freedom."""
    part = 2 / (9 * freedom)
    return freedom * max(0.0, 1 - part + normal_quantile(p) * math.sqrt(part)) ** 3
