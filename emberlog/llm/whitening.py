"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The rows of X are the distinct vectors, centred. From a unit vector ``v`` the method goes to and fro: ``u`` is Xv and
the next ``v`` is Xᵀu, each made orthogonal to all before it. X then has the small upper triangular R (bidiagonal but
for what the orthogonalisation takes away) in the bases U and V, and R's singular values and vectors give the largest
components and their deviations.

V, R and what Xᵀ makes of U have the size of a vector times the number of steps and stay on the driver. U has a row
for each vector and is never kept: ``U = X V R⁻¹``, so a task makes its part anew from the vectors it reads. One step is
one pass that sums, for ``w = Xv``, the numbers ``Xᵀw``, ``Uᵀw`` and ``wᵀw``; by them w is made orthogonal to U and
Xᵀ of the result follows, as Xᵀ of all earlier u is known. Only sums are shuffled, of one row for each number and task.

Steps end when the wanted components fit to ``TOLERANCE``, or with the dimension. A start vector sees one direction of
an eigenvalue that occurs twice, so after that a few steps from another start have to leave the components as they are.

Defined cases: rows whose vector is null or has a null or infinite entry or NaN are left out, and so are those of
another length than the commonest (of two, the longer). Rows that repeat are one vector of the fit list and a row each
in the result. Directions without any deviation are no components, so vectors that are all equal give no rows; an
empty table gives none. A deviation that no long can hold is null. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import shared_dir, small

#: An entry c counts as the whole number floor(SCALE * c).
SCALE = 256
COMPONENTS = 4
#: Residual of a component, as a share of the largest singular value.
TOLERANCE = 1e-14
#: Below this share of the largest singular value a number is none.
NOTHING = 1e-11
#: Steps from another start that must not change the components.
CONFIRM = 6
FITS = 2.0**62


@dataclass
class Basis:
    """What whitens a vector: ``n`` vectors with the sums ``sums``; a column of ``axes`` for each component."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.variances)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (x * n - sums) / n


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of a list column count, the lengths of these rows, and all their entries as whole numbers."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    given = np.asarray(pc.is_valid(column))
    values = np.asarray(pc.fill_null(column.flatten().cast(pa.float64()), float("nan")))
    row = np.repeat(np.arange(len(column)), lengths)
    good = given & (np.bincount(row[~np.isfinite(values)], minlength=len(column)) == 0)
    return good, lengths[good], np.floor(SCALE * values[good[row]]).astype(np.int64)


def listed(lengths: np.ndarray, entries: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(entries))


def whole_vectors(rows: DataFrame) -> DataFrame:
    """``x``: the vectors that count, as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            _, lengths, entries = whole(batch.column(0))
            yield pa.RecordBatch.from_arrays([listed(lengths, entries)], ["x"])

    return rows.select(F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "x array<long>")


def matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """Vectors of ``d`` entries, as rows of matrices."""
    for batch in small(batches, 4096):
        yield np.asarray(batch.column(0).flatten()).reshape(-1, d)


def summed(fit: DataFrame, d: int, size: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all vectors of what ``part`` makes of a matrix of some: ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64 if kind == "long" else np.float64)
        for x in matrices(batches, d):
            sums += part(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(sums)], ["at", "v"])

    found = fit.mapInArrow(run, f"at int, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for row in found:
        out[row["at"]] = row["v"]
    return out


def away(vector: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``vector`` without its parts along the columns of ``basis``."""
    for _ in range(2):
        vector = vector - basis @ (basis.T @ vector)
    return vector


def bidiagonalise(fit: DataFrame, d: int, n: int, sums: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of the centred rows of ``fit``, and the right vectors as columns."""
    rng = np.random.default_rng(20_240_101)
    tried = np.zeros((d, 0))  # V
    upper = np.zeros((0, 0))  # R: a row for each u, a column for each v
    own: list[int] = []  # for each u, the number of the v that it came from
    back = np.zeros((d, 0))  # X'u for each u
    lost: list[tuple[int, float]] = []  # where another start was taken: number of u, and the beta left behind
    rest, beta, checked = np.zeros(d), 0.0, None
    values, left, turn = np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0))
    while tried.shape[1] < d:
        largest, k = values[:1].sum(), len(own)
        if fresh := beta <= NOTHING * largest:
            rest, beta = rng.standard_normal(d), 0.0
        v = away(away(rest, tried) / np.linalg.norm(away(rest, tried)), tried)
        v /= np.linalg.norm(v)
        right, solve = tried[:, own], np.linalg.inv(upper[:, own])

        def part(x: np.ndarray, v=v, right=right, solve=solve, beta=beta) -> np.ndarray:
            rows = centred(x, n, sums)
            w, u = rows @ v, rows @ right @ solve
            if beta:
                w = w - beta * u[:, -1]
            return np.concatenate([rows.T @ w, u.T @ w, [w @ w]])

        found = summed(fit, d, d + k + 1, part)
        h, length = found[d : d + k], found[-1]
        alpha = float(np.sqrt(max(0.0, length - h @ h)))
        new = alpha > NOTHING * largest
        if fresh and not new and np.linalg.norm(h) <= NOTHING * largest:
            break  # a vector of no special direction goes to nothing, so all that is left does
        column = h.copy()
        if beta:
            column[-1] += beta
        tried, upper = np.column_stack([tried, v]), np.column_stack([upper, column])
        if new:
            z = (found[:d] - back @ h) / alpha
            upper = np.vstack([upper, np.zeros(upper.shape[1])])
            upper[-1, -1] = alpha
            own, back = [*own, tried.shape[1] - 1], np.column_stack([back, z])
            rest = away(z, tried)
            beta = float(np.linalg.norm(rest))
        else:  # Xv has no part outside of U
            rest, beta = np.zeros(d), 0.0
        left, values, turn = np.linalg.svd(upper)
        best = values[:wanted]
        residual = sum((miss * np.abs(left[at - 1, : len(best)]) for at, miss in [*lost, (len(own), beta)]), np.zeros(len(best)))
        if len(best) == min(wanted, d) and (residual <= TOLERANCE * values[0]).all():
            if checked is None or not np.allclose(best, checked[1], rtol=1e-10, atol=0):
                lost, beta = [*lost, (len(own), beta)], 0.0
                checked = tried.shape[1], best
            elif tried.shape[1] - checked[0] >= CONFIRM:
                break
    keep = [i for i in range(min(wanted, len(values))) if values[i] > 1e-9 * values[0]]
    axes = tried @ turn.T[:, keep]
    return values[keep], axes / np.linalg.norm(axes, axis=0)


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Basis | None:
    """The basis of the vectors of ``rows``; None if there are none. Distinct vectors are written to the shared folder."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    whole_vectors(rows).distinct().write.parquet(folder)
    fit = spark.read.schema("x array<long>").parquet(folder)
    sizes = fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes or not sizes[0]["d"]:
        return None
    d, n = sizes[0]["d"], sizes[0]["n"]
    fit = fit.where(F.size("x") == d)
    sums = summed(fit, d, d, lambda x: x.sum(axis=0), "long")
    values, axes = bidiagonalise(fit, d, n, sums, components)
    trace = summed(fit, d, 1, lambda x: np.array([np.square(centred(x, n, sums)).sum()]))[0] / n
    basis = Basis(n, sums, axes, values**2 / n, float(trace))
    if m := len(values):

        def moments(x: np.ndarray) -> np.ndarray:
            white = basis.whitened(x)
            return np.r_[white.sum(axis=0), (white.T @ white).ravel()]

        found = summed(fit, d, m + m * m, moments) / n
        covariance = found[m:].reshape(m, m) - np.outer(found[:m], found[:m])
        basis.identity_error = float(np.abs(covariance - np.eye(m)).max())
    return basis


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums over the entries of ``(n * x - sums) ** 2``."""
    bound = n * np.abs(x).max(initial=0).astype(float) + np.abs(sums).max(initial=0).astype(float)
    if bound**2 * max(1, x.shape[1]) < FITS:
        return np.square(x * n - sums).sum(axis=1).tolist()
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [e if e < 2**63 else None for e in exact]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that counts and each component: see ``SCHEMA``."""
    basis = fitted(rows, components)
    if basis is None or not len(basis.variances):
        return rows.sparkSession.createDataFrame([], SCHEMA)
    d, m = len(basis.sums), len(basis.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            good, lengths, entries = whole(batch.column(1))
            fits = lengths == d
            x = entries[np.repeat(fits, lengths)].reshape(-1, d)
            ids = batch.column(0).filter(pa.array(good)).filter(pa.array(fits))
            rows_of = np.repeat(np.arange(len(x)), m)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(rows_of)),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows_of), basis.n)),
                    pa.array(deviations(x, basis.n, basis.sums), pa.int64()).take(pa.array(rows_of)),
                    pa.array(basis.whitened(x).ravel()),
                    pa.array(np.tile(basis.variances / basis.trace, len(x))),
                    pa.array(np.full(len(rows_of), basis.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, SCHEMA)
