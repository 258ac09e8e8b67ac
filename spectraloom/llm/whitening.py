"""Whitening of embeddings: QDWH spectral divide and conquer on the covariance, then one projection of every row.

The eigenvectors come from polar decompositions alone. The orthogonal polar factor U of a shifted covariance A - sI tells on
which side of s each eigenvalue lies, so (U + I) / 2 is the projector onto the invariant subspace above s. A basis of that
subspace and one of its complement cut A into two smaller matrices, and so on until single components are left.

The covariance is one distributed pass over centred vectors; the driver holds matrices of dimensions by dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.plans.moments import matrix, moments

EPSILON = float(np.finfo(float).eps)
#: Whole-number vectors: entries are cut to 1 / GRID and moved by OFFSET.
GRID, OFFSET = 1024, 100_000
COMPONENTS = 8
LARGEST_LONG = 2**63 - 1
#: Entries times the grid stay below this, so that the offset can be added.
LARGEST_DOUBLE = 2.0**62


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of the polar decomposition, by dynamically weighted Halley iterations in their QR form.

    ``least`` bounds the singular values from below; the weights are the best ones for that bound, so the iteration needs
    six or seven steps however ill-conditioned the matrix is. A zero singular value leaves its direction undefined.
    """
    size, norm = len(a), np.linalg.norm(a)
    if not norm:
        return np.eye(size)
    x, least, identity = a / norm, EPSILON / 4, np.eye(size)
    for _ in range(30):
        square = least * least
        root = (4 * (1 - square) / square**2) ** (1 / 3)
        stem = np.sqrt(1 + root)
        first = stem + np.sqrt(max(8 - 4 * root + 8 * (2 - square) / (square * stem), 0.0)) / 2
        second = (first - 1) ** 2 / 4
        third = first + second - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(third) * x, identity]))
        before, x = x, second / third * x + (first - second / third) / np.sqrt(third) * (q[:size] @ q[size:].T)
        least = min(1.0, least * (first + second * square) / (1 + third * square))
        if 1 - least < 10 * EPSILON and np.linalg.norm(x - before) < EPSILON ** (1 / 3):
            break
    return x


def invariant_subspaces(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Orthonormal bases of the eigenvectors above and below the shift, and the part of ``a`` that couples them."""
    size = len(a)
    projector = (polar_factor(a - shift * np.eye(size)) + np.eye(size)) / 2
    projector = (projector + projector.T) / 2
    above = min(max(round(float(np.trace(projector))), 0), size)
    basis = np.random.default_rng(0).normal(size=(size, size))
    for _ in range(2):
        both = np.hstack([projector @ basis[:, :above], basis[:, above:] - projector @ basis[:, above:]])
        basis, _ = np.linalg.qr(both)
    upper, lower = basis[:, :above], basis[:, above:]
    return upper, lower, float(np.linalg.norm(upper.T @ a @ lower)) if 0 < above < size else np.inf


def eigenvectors(a: np.ndarray, scale: float | None = None) -> np.ndarray:
    """Columns: orthonormal eigenvectors of a symmetric matrix, in no order.

    Eigenvalues closer to each other than rounding errors of the whole matrix share a subspace, of which any basis will do.
    """
    size, scale = len(a), np.linalg.norm(a) if scale is None else scale
    middle = np.trace(a) / max(size, 1)
    if size <= 1 or np.linalg.norm(a - middle * np.eye(size)) <= 4 * EPSILON * scale:
        return np.eye(size)
    diagonal = np.diag(a)
    radius = np.linalg.norm(a - middle * np.eye(size)) / np.sqrt(size)
    shifts = [float(np.median(diagonal)), middle, *(middle + radius * t for t in (0.1, -0.1, 0.3, -0.3, 0.6, -0.6, 1.0, -1.0, 1e-3, -1e-3))]
    best = None
    for shift in shifts:
        upper, lower, coupling = invariant_subspaces(a, shift)
        if upper.shape[1] in (0, size):
            continue
        if best is None or coupling < best[2]:
            best = upper, lower, coupling
        if coupling <= 8 * size * EPSILON * scale:
            break
    if best is None:
        raise ArithmeticError("no shift divides the spectrum")
    upper, lower, _ = best
    parts = [v @ eigenvectors(symmetric(v.T @ a @ v), scale) for v in (upper, lower)]
    return np.hstack(parts)


def symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def polished(a: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One step that squares the remaining error of eigenvectors, where their eigenvalues are well apart, and one that squares
    what they lack of being orthonormal."""
    rest = np.eye(len(a)) - vectors.T @ vectors
    inside = vectors.T @ a @ vectors
    values = np.diag(inside) / (1 - np.diag(rest))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > EPSILON**0.5 * np.abs(values).max(initial=0.0)
    step = np.where(apart, (inside + values[None, :] * rest) / np.where(apart, gap, 1.0), rest / 2)
    np.fill_diagonal(step, np.diag(rest) / 2)
    vectors = vectors + vectors @ step
    return vectors @ (3 * np.eye(len(a)) - vectors.T @ vectors) / 2


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns, the largest entry of each (the first of equal ones) positive."""
    vectors = polished(a, eigenvectors(a))
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    largest = np.abs(vectors).argmax(axis=0)
    return values[order], vectors * np.where(vectors[largest, np.arange(len(a))] < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Whitening:
    """``sums`` are exact; ``directions`` has a row per component: the eigenvector over the root of its eigenvalue."""

    rows: int
    sums: tuple[int, ...]
    extent: tuple[tuple[int, int], ...]
    values: np.ndarray
    trace: float
    directions: np.ndarray
    identity_error: float = 0.0

    @property
    def means(self) -> list[float]:
        return [s / self.rows for s in self.sums]


def whole_numbers(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", grid: int = GRID, offset: int = OFFSET) -> DataFrame:
    """``id, vector``: every entry cut to a whole number, floor(grid * entry) + offset.

    Rows whose vector is NULL or holds a NULL or an entry that is not finite (or whose number no long can hold) are left out,
    as are vectors of another length than the longest (an empty one too). Repeated rows stay.
    """
    df = df.select(df[id_column].alias("id"), df[vector_column].cast("array<double>").alias("vector"))
    fits = F.coalesce(F.forall("vector", lambda c: c.isNotNull() & (F.abs(c * float(grid)) < LARGEST_DOUBLE)), F.lit(False))
    df = df.where(fits)
    size = df.agg(F.max(F.size("vector"))).first()[0] or 0
    # Guarded, because the order in which a plan tests and computes is not fixed.
    cut = F.transform("vector", lambda c: F.when(F.abs(c * float(grid)) < LARGEST_DOUBLE, F.floor(c * float(grid)) + F.lit(offset).cast("long")))
    return df.where((F.size("vector") == size) & F.lit(size > 0)).select("id", cut.alias("vector"))


def whitened(numbers: np.ndarray, model: Whitening) -> np.ndarray:
    """The components of vectors of whole numbers, one vector per row."""
    return (numbers - np.asarray(model.means)) @ model.directions.T


def learn_whitening(vectors: DataFrame, count: int = COMPONENTS) -> Whitening | None:
    """From all rows of ``whole_numbers``, in three passes: sums and extents, products of centred vectors, and a check of the
    result.

    Components without variance (to double precision) are none. None for an empty table.
    """
    entries = vectors.select(F.posexplode("vector").alias("at", "x")).groupBy("at")
    found = entries.agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("at").collect()
    if not found:
        return None
    size, rows, sums = len(found), found[0].n, tuple(r.s for r in found)
    model = Whitening(rows, sums, tuple((r.lo, r.hi) for r in found), np.zeros(0), 0.0, np.zeros((0, size)))
    products = moments(vectors, F.col("vector"), size)[0].scatter / rows
    values, basis = spectrum(products)
    used = [k for k in range(min(count, size)) if values[k] > 4 * size * EPSILON * values[0]]
    directions = basis[:, used].T / np.sqrt(values[used])[:, None]
    model = Whitening(rows, sums, model.extent, values[used], float(np.trace(products)), directions)
    if not used:
        return model
    @F.arrow_udf("array<double>")
    def projected(batch: pa.Array) -> pa.Array:
        found = whitened(matrix(batch, size), model)
        return pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(used)).cast(pa.list_(pa.float64()))

    check = moments(vectors.select(projected("vector").alias("found")), F.col("found"), len(used))[0].scatter / rows
    error = float(np.abs(check - np.eye(len(used))).max())
    return Whitening(rows, sums, model.extent, values[used], model.trace, directions, error)


def deviations(numbers: np.ndarray, model: Whitening) -> list[int | None]:
    """For each vector the exact sum over dimensions of (rows * x - sum)^2; None where no long can hold it."""
    most = sum(max(abs(model.rows * hi - s), abs(model.rows * lo - s)) ** 2 for s, (lo, hi) in zip(model.sums, model.extent))
    # Whole numbers of any size where those of 64 bits may overflow.
    kind = np.int64 if most <= LARGEST_LONG else object
    found = ((numbers.astype(kind) * model.rows - np.array(model.sums, kind)) ** 2).sum(axis=1)
    return [d if d <= LARGEST_LONG else None for d in found.tolist()]


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """A row per vector and component: ``id, component`` (from 1, by falling eigenvalue), ``n, deviation, whitened, explained``
    and ``identity_error``, the largest entry by which the covariance of all whitened rows differs from the identity.

    A projection in batches with the model as a constant: nothing is shuffled.
    """
    kinds = f"id {vectors.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], kinds)
    size, count = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            rows = len(numbers)
            at, component = np.repeat(np.arange(rows), count), np.tile(np.arange(count, dtype=np.int32), rows)
            columns = [
                batch.column(0).take(pa.array(at)), pa.array(component + 1), pa.array(np.full(rows * count, model.rows)),
                pa.array(deviations(numbers, model), pa.int64()).take(pa.array(at)), pa.array(whitened(numbers, model).ravel()),
                pa.array((model.values / model.trace)[component]), pa.array(np.full(rows * count, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, kinds)
