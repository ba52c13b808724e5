"""Projection on leading singular vectors of the standardised training vectors, by a blocked randomised range finder.

Rows times a small basis are a thin block per task. A tree of QR factors brings the blocks' triangles to one, which
says how to combine them into an orthonormal range without any task seeing the others' rows; a second pass multiplies
that range with the rows and gives a small matrix whose singular vectors are the answer. A basis as wide as the matrix
or its rows makes the first range exact. Else the leading vectors and those of the round before are the next basis, until
the singular values stand still. One path serves every shape, and directions that the rows do not span always
project to 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cohortgrid.cluster import durable
from cohortgrid.fixed import NO_REDUCTION, REDUCTION_NAME
from cohortgrid.operators.moments import vector_moments
from cohortgrid.operators.partials import collected, dense, list_column, summed
from cohortgrid.operators.quality import feature_scaler, varying_features

LOADING_BYTES = 256 << 20
BASIS_BYTES = 64 << 20
BASIS = 1024  # columns of a basis at most, if k does not ask for more
SPARE = 16  # columns beyond k at least
SPANNED = 1e-7  # of the largest singular value; smaller ones are no direction of the data
STILL = 1e-13  # relative change of the leading squared singular values
ROUNDS = 60
FAN = 8  # triangles that one task of the tree joins
SEED = 20240229


@dataclass(frozen=True)
class Reduction:
    """Column `columns[j]` of x, shifted and scaled, times loadings (d x k)."""

    columns: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    loadings: np.ndarray
    width: int

    @property
    def k(self) -> int:
        return self.loadings.shape[1]

    def names(self) -> list[str]:
        return [f"PC{i + 1}" for i in range(self.k)]

    def project(self, x="x"):
        """Column: the vector x on the components."""
        columns, mean, sd, loadings, width = self.columns, self.mean, self.sd, self.loadings, self.width

        @F.arrow_udf(ArrayType(DoubleType()))
        def projected(column: pa.Array) -> pa.Array:
            return list_column(((dense(column, width)[:, columns] - mean) / sd) @ loadings)

        return projected(x)


@dataclass(frozen=True)
class _Rows:
    """The standardised rows, as tasks read them."""

    vectors: DataFrame
    width: int
    columns: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    def reader(self):
        width, columns, mean, sd = self.width, self.columns, self.mean, self.sd
        return lambda batch: (dense(batch.column("x"), width)[:, columns] - mean) / sd


def feature_gram(
    vectors: DataFrame, width: int, columns: np.ndarray, mean: np.ndarray, sd: np.ndarray
) -> DataFrame:
    """(row, v): rows of the Gram matrix of the standardised features, summed over all samples."""
    size = len(columns)
    read = _Rows(vectors, width, np.asarray(columns), mean, sd).reader()

    def add(blocks, batch):
        x = read(batch)
        blocks[0] += x.T @ x

    return summed(vectors.select("x"), lambda: {0: np.zeros((size, size))}, add).select("row", "v")


def _stacked(triangles: Iterator[np.ndarray]) -> np.ndarray | None:
    """The triangle of all rows of the given ones."""
    held = None
    for t in triangles:
        held = np.linalg.qr(t if held is None else np.vstack([held, t]), mode="r")
    return held


def range_triangle(rows: _Rows, basis: np.ndarray) -> np.ndarray:
    """The triangular factor of all rows times the basis, at most as many rows as the basis has columns."""
    size, read = basis.shape[1], rows.reader()

    def packed(triangle: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if triangle is not None:
            flat = pa.array([triangle.ravel()], pa.list_(pa.float64()))
            yield pa.record_batch([flat], names=["r"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(_stacked(read(b) @ basis for b in batches if b.num_rows))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(_stacked(np.reshape(r, (-1, size)) for b in batches for r in b.column("r").to_numpy(zero_copy_only=False)))

    parts = rows.vectors.select("x").mapInArrow(own, "r array<double>")
    tasks = rows.vectors.rdd.getNumPartitions()
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        parts = parts.repartition(tasks).mapInArrow(join, "r array<double>")
    found = _stacked(np.reshape(r["r"], (-1, size)) for r in parts.toLocalIterator())
    return np.zeros((1, size)) if found is None else found


def cover(rows: _Rows, combined: np.ndarray) -> np.ndarray:
    """The transposed rows times the orthonormal range (rows times combined): features x columns."""
    size, columns, read = len(rows.columns), combined.shape[1], rows.reader()

    def add(blocks, batch):
        z = read(batch)
        blocks[0] += z.T @ (z @ combined)

    sums = summed(rows.vectors.select("x"), lambda: {0: np.zeros((size, columns))}, add)
    return collected(sums, {0: (size, columns)})[0]


def leading_vectors(rows: _Rows, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns): the k largest singular values of n rows and their right singular vectors.

    A vector whose value is under SPANNED of the largest is 0. After ROUNDS the values found are taken; by then
    they no longer change in any digit that their distance to the next one lets a sample's score show.
    """
    size = len(rows.columns)
    most = min(size, n)
    wide = min(most, max(k + SPARE, min(BASIS, BASIS_BYTES // (8 * size))))
    basis = np.eye(size) if wide == size else np.random.default_rng(SEED).standard_normal((size, wide))
    basis = np.linalg.qr(basis)[0]
    before = None
    for _ in range(ROUNDS):
        triangle = range_triangle(rows, basis)
        if not np.isfinite(triangle).all():
            raise ValueError("vectors to reduce must not have missing values")
        _, s, right = np.linalg.svd(triangle, full_matrices=False)
        kept = s > 1e-12 * max(s[0], 1e-300)
        if not kept.any():
            return np.zeros(k), np.zeros((size, k))
        wide_vectors, values, _ = np.linalg.svd(cover(rows, basis @ (right[kept].T / s[kept])), full_matrices=False)
        if before is None and wide == most:
            break
        now = values[:k] ** 2
        if before is not None and len(before) == len(now) and (np.abs(now - before) <= STILL * now[0]).all():
            break
        before, last = now, basis[:, :wide]
        basis = np.linalg.qr(np.hstack([wide_vectors[:, :wide], last]))[0][:, : min(size, 2 * wide)]
    values, vectors = values[:k], wide_vectors[:, :k]
    vectors = np.where(values > SPANNED * values[0], vectors, 0.0)
    missing = k - len(values)
    return np.pad(values, (0, missing)), np.pad(vectors, ((0, 0), (0, missing)))


def oriented(loadings: np.ndarray) -> np.ndarray:
    """Fix the sign of each column: its largest entry in absolute value is positive."""
    if not loadings.size:
        return loadings
    top = loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])]
    return loadings * np.where(top < 0, -1.0, 1.0)


def _scales(moments: DataFrame, kind: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    table = feature_scaler(moments, kind).toArrow()
    mean, sd = np.zeros(width), np.full(width, np.nan)
    at = table.column("ord").to_numpy()
    mean[at] = table.column("mean").to_numpy()
    sd[at] = table.column("sd").to_numpy()
    return mean, sd


def fit_reduction(
    vectors: DataFrame, width: int, k: int, kind: str = "sample", drop_near_zero: bool = True
) -> Reduction:
    """Leading k components of vectors(sample_id, x) after scaling; k is capped by rows and columns.

    kind as in quality.scaler; components are always taken around the mean, also for kind "none".
    """
    if width * k * 8 > LOADING_BYTES:
        raise ValueError(f"{width} x {k} loadings are too many for one model; select features first")
    vectors = durable(vectors.select("sample_id", "x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = vectors.count()
        moments = durable(vector_moments(vectors, width))
        columns = np.arange(width)
        if drop_near_zero:
            varied = varying_features(vectors, moments, n)
            columns = np.sort(varied.toArrow().column("ord").to_numpy())
        mean, sd = _scales(moments, "center" if kind == "none" else kind, width)
        k = min(k, n, len(columns))
        if k <= 0:
            raise ValueError("nothing left to reduce")
        rows = _Rows(vectors, width, columns, mean[columns], sd[columns])
        loadings = leading_vectors(rows, n, k)[1]
    finally:
        vectors.unpersist()
    return Reduction(columns, mean[columns], sd[columns], oriented(loadings), width)


def parse_reduction(spec: str | None) -> int:
    """Number of components: of "svd<k>" k, of a word for no reduction or of nothing 0."""
    asked = "" if spec is None else spec.strip().lower()
    if asked in NO_REDUCTION:
        return 0
    count = asked.removeprefix(REDUCTION_NAME)
    if count == asked or not (count.isascii() and count.isdecimal()):
        raise ValueError(f"cannot read the reduction {spec!r}: give {REDUCTION_NAME} and a number, or none")
    return int(count)


def reduce_if_wider(train: DataFrame, test: DataFrame, width: int, k: int) -> tuple[DataFrame, DataFrame, int]:
    """Project both sides on k components of the training vectors; matrices of k columns or fewer are
    left as they are, not even scaled."""
    if k >= width:
        return train, test, width
    model = fit_reduction(train, width, k)
    return train.withColumn("x", model.project("x")), test.withColumn("x", model.project("x")), model.k


def reduce_by_spec(
    train: DataFrame, test: DataFrame, width: int, spec: str | None, kind: str = "standardize"
) -> tuple[DataFrame, DataFrame, int]:
    """Principal components by "svd<k>" with kind standardize, center or none."""
    kinds = {"standardize": "population", "center": "center", "none": "none"}
    if kind.lower() not in kinds:
        raise ValueError("scaling before the reduction must be standardize, center or none")
    k = parse_reduction(spec)
    if not k:
        return train, test, width
    model = fit_reduction(train, width, k, kinds[kind.lower()], drop_near_zero=False)
    return train.withColumn("x", model.project("x")), test.withColumn("x", model.project("x")), model.k
