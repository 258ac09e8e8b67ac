"""Arithmetic of array columns against constant vectors, as expressions: no Python at run time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spectraloom.functions.names import number_array


def added(a: Column, b: Column) -> Column:
    return a + b


def dot(a: Column, b: Column) -> Column:
    """Sum of products; NULL if a value is missing in either, or if the lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), added)


def minus(values: Column, constants: Sequence[float]) -> Column:
    return F.zip_with(values, number_array(map(float, constants)), lambda x, m: x - m)


def number_table(rows: Sequence[Sequence[float]]) -> Column:
    """A constant array of arrays of finite numbers. Written as text that the optimizer turns into one literal: planning
    tens of thousands of literals takes seconds."""
    written = ",".join("[" + ",".join(repr(float(v)) for v in row) + "]" for row in rows)
    return F.from_json(F.lit(f"[{written}]"), "array<array<double>>")


def projected(values: Column, rows: Sequence[Sequence[float]]) -> Column:
    """The dot products of an array with each of some constant vectors. ``values`` must be a bound or stored column."""
    return F.transform(number_table(rows), lambda row: dot(row, values))


def running(values: Column, starts: Sequence[int], width: int, body: Callable[[Column, Column], Column]) -> Column:
    """For each start (from 0) ``body(window, position)`` of the window of ``width`` values there."""
    return F.transform(number_array(list(starts)), lambda start, i: body(F.slice(values, start + 1, F.lit(width)), i))
