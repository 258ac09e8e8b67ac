"""Counts, means and centred cross products of array columns, by group, in one pass over the rows.

A task folds its rows, a batch at a time, into one set of moments per group and hands on the matrix in horizontal blocks;
blocks are merged in two steps, so no task receives more than a share of the matrices, and the driver gets one matrix per
group. Merging keeps every product centred on a mean, so a large mean costs no digits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the matrix that travel together.
BLOCK = 128
#: Tasks that merge the same block in the first step.
FAN = 16

PARTIAL = "fold int, block int, part int, n long, mean array<double>, rows array<double>"


@dataclass(frozen=True)
class Moments:
    """``scatter`` is the sum over rows of the products of deviations from ``mean``; it may hold a block of rows only, the
    deviations at ``first`` and after."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    first: int = 0

    @classmethod
    def none(cls, size: int) -> Moments:
        return cls(0, np.zeros(size), np.zeros((size, size)))

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        mean = rows.mean(axis=0)
        centred = rows - mean
        return cls(len(rows), mean, centred.T @ centred)

    def merge(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n, shift = self.n + other.n, other.mean - self.mean
        own = shift[self.first : self.first + len(self.scatter)]
        between = np.outer(own, shift) * (self.n * other.n / n)
        return Moments(n, self.mean + shift * (other.n / n), self.scatter + other.scatter + between, self.first)

    @property
    def covariance(self) -> np.ndarray:
        """With divisor n - 1."""
        return self.scatter / (self.n - 1)


def merged(moments: Iterable[Moments], size: int) -> Moments:
    return reduce(Moments.merge, moments, Moments.none(size))


def complete(values: Column, size: int) -> Column:
    """Whether an array has ``size`` finite values."""
    finite = F.forall(values, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(values) == size) & finite, F.lit(False))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """An Arrow column of arrays of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    names = [c.split()[0] for c in PARTIAL.split(", ")]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def folded(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    found: dict[int, Moments] = {}
    for batch in batches:
        folds, values = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1), size)
        for fold in np.unique(folds).tolist():
            found[fold] = found.get(fold, Moments.none(size)).merge(Moments.of(values[folds == fold]))
    part = TaskContext.get().partitionId() % FAN
    for fold, m in found.items():
        for first in range(0, size, BLOCK):
            yield batch_of([(fold, first // BLOCK, part, m.n, m.mean, m.scatter[first : first + BLOCK].ravel())])


def combined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, Moments] = {}
    for batch in batches:
        for r in range(batch.num_rows):
            fold, block, part, n = (batch.column(c)[r].as_py() for c in range(4))
            mean, rows = (batch.column(c)[r].values.to_numpy() for c in (4, 5))
            m = Moments(n, mean, rows.reshape(-1, size), block * BLOCK)
            found[fold, block, part] = found[fold, block, part].merge(m) if (fold, block, part) in found else m
    for key, m in found.items():
        yield batch_of([(*key, m.n, m.mean, m.scatter.ravel())])


def moments(df: DataFrame, values: Column, size: int, fold: Column | None = None) -> dict[int, Moments]:
    """Moments of an array column by ``fold`` (an int; default one group, 0), from the rows that have ``size`` finite values.

    A NULL fold takes no part. The driver holds a matrix of ``size`` squared per fold, whatever the number of rows.
    """
    fold = F.lit(0) if fold is None else fold
    narrow = df.select(fold.cast("int").alias("fold"), values.cast("array<double>").alias("x"))
    narrow = narrow.where(F.col("fold").isNotNull() & complete(F.col("x"), size))
    partial = narrow.mapInArrow(lambda batches: folded(batches, size), PARTIAL)
    partial = partial.repartition("fold", "block", "part").mapInArrow(lambda batches: combined(batches, size), PARTIAL)
    partial = partial.withColumn("part", F.lit(0)).repartition("fold", "block")
    final = partial.mapInArrow(lambda batches: combined(batches, size), PARTIAL).toArrow()
    found: dict[int, list[tuple]] = {}
    for fold_, block, _, n, mean, rows in zip(*(c.to_pylist() if i < 4 else c for i, c in enumerate(final.columns))):
        found.setdefault(fold_, []).append((block, n, mean.values.to_numpy(), rows.values.to_numpy()))
    result = {}
    for fold_, blocks in sorted(found.items()):
        blocks.sort(key=lambda b: b[0])
        scatter = np.vstack([rows.reshape(-1, size) for *_, rows in blocks])
        result[fold_] = Moments(blocks[0][1], blocks[0][2], (scatter + scatter.T) / 2)
    return result
