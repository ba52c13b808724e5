"""Statistics per feature and class from vectors: one pass, one shuffle, and no row per cell.

A task folds its vectors into arrays over the features: count, mean, squared deviations, extremes, and values over a
cutoff, for each class. These blocks merge (the two means and their distance give the deviations of both), so a task
sends one block for each run of features and class, or the vectors themselves where a class has too few of them for a
block to be smaller. The task of a run merges them and puts out one row per feature that lists its classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortgrid.cluster import join_side, task_count
from cohortgrid.matrix import RUN_FEATURES, Matrix
from cohortgrid.operators.partials import dense

STATE_BYTES = 256 << 20  # of the blocks a task holds before it hands them on
LEAST_RUN = 16
N, MEAN, SS, LOW, HIGH, OVER = range(6)
ENTRY = "array<struct<class:string,n:bigint,total:double,ss:double,mean:double,low:double,high:double,over:bigint>>"


def block_of(x: np.ndarray, cutoff: float) -> np.ndarray:
    """The statistics of rows x features; NaN is missing. Without values: n 0, mean 0, low inf, high -inf."""
    known = ~np.isnan(x)
    n = known.sum(axis=0)
    some = np.maximum(n, 1)
    mean = np.where(known, x, 0.0).sum(axis=0) / some
    apart = np.where(known, x - mean, 0.0)
    ss = (apart * apart).sum(axis=0) - apart.sum(axis=0) ** 2 / some  # the second term is what mean lost in rounding
    low, high = np.where(known, x, np.inf).min(axis=0), np.where(known, x, -np.inf).max(axis=0)
    return np.stack([n, mean, np.maximum(ss, 0.0), low, high, (known & (x > cutoff)).sum(axis=0)]).astype(float)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The statistics of the rows of a and b together."""
    n = a[N] + b[N]
    share = b[N] / np.maximum(n, 1)
    step = b[MEAN] - a[MEAN]
    ss = a[SS] + b[SS] + step * step * a[N] * share
    low, high = np.minimum(a[LOW], b[LOW]), np.maximum(a[HIGH], b[HIGH])
    return np.stack([n, a[MEAN] + step * share, ss, low, high, a[OVER] + b[OVER]])


class _Class:
    """The vectors of one class in a task: kept as they are while they are few, then as a block."""

    def __init__(self):
        self.rows: list[np.ndarray] = []
        self.block: np.ndarray | None = None

    def add(self, x: np.ndarray, cutoff: float) -> None:
        if self.block is None and sum(map(len, self.rows)) + len(x) <= OVER + 1:
            self.rows.append(x)
            return
        if self.rows:
            x = np.vstack([*self.rows, x])
            self.rows = []
        block = block_of(x, cutoff)
        self.block = block if self.block is None else merged(self.block, block)


def _partials(width: int, run: int, cutoff: float):
    """(start, class, s): a block of a run (statistic by statistic), or one vector's values of it."""

    def out(classes: dict) -> Iterator[pa.RecordBatch]:
        for name, held in classes.items():
            whole = np.vstack(held.rows) if held.block is None else held.block.reshape(1, -1)
            parts = 1 if held.block is None else OVER + 1
            for row in whole:
                table = row.reshape(parts, width)
                starts = list(range(0, width, run))
                pieces = [np.ascontiguousarray(table[:, s : s + run]).ravel() for s in starts]
                ends = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(starts, pa.int32()),
                        pa.array([name] * len(starts), pa.string()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces))),
                    ],
                    ["start", "class", "s"],
                )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str | None, _Class] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = dense(batch.column("x"), width)
            coded = batch.column("class").dictionary_encode(null_encoding="encode")
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            for i in np.unique(codes).tolist():
                classes.setdefault(names[i], _Class()).add(x[codes == i], cutoff)
            if len(classes) * width * (OVER + 1) * 8 > STATE_BYTES:
                yield from out(classes)
                classes = {}
        yield from out(classes)

    return fold


def _merge(width: int, run: int, cutoff: float):
    """One row per feature of the runs of this task: (ord, class, n, mean, ss, low, high, over) with lists by class."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, dict[str | None, np.ndarray]] = {}
        for batch in batches:
            lists = batch.column("s")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, (start, name) in enumerate(zip(batch.column("start").to_pylist(), batch.column("class").to_pylist())):
                size = min(run, width - start)
                given = values[ends[i] : ends[i + 1]].reshape(-1, size)
                block = block_of(given.astype(float), cutoff) if len(given) == 1 else given
                classes = runs.setdefault(start, {})
                classes[name] = merged(classes[name], block) if name in classes else block
        for start, classes in runs.items():
            names = sorted(classes, key=lambda c: (c is None, c))
            size = min(run, width - start)
            held = np.stack([classes[c] for c in names])  # classes x statistics x features
            ends = pa.array(np.arange(0, size * len(names) + 1, len(names), dtype=np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(names * size, pa.string()))]
            for k in range(OVER + 1):
                flat = np.ascontiguousarray(held[:, k, :].T).ravel()
                lists.append(pa.ListArray.from_arrays(ends, pa.array(flat.astype(np.int64) if k in (N, OVER) else flat)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(start, start + size, dtype=np.int32)), *lists],
                ["ord", "class", "n", "mean", "ss", "low", "high", "over"],
            )

    return fold


def vector_moments(
    vectors: DataFrame, width: int, group: str | None = None, column: str = "x", cutoff: float = np.inf
) -> DataFrame:
    """(ord, c): for each feature a list of (class, n, total, ss, mean, low, high, over) by class, null last.

    n counts the values, over those above the cutoff; ss sums the squared deviations from the class mean. mean, low
    and high are null without values. Without a group all vectors are of the class null. No vectors give no rows.
    """
    run = int(min(RUN_FEATURES, max(LEAST_RUN, -(-width // task_count(vectors.sparkSession)))))
    name = F.col(group).cast("string") if group else F.lit(None).cast("string")
    partials = vectors.select(F.col(column).alias("x"), name.alias("class")).mapInArrow(
        _partials(width, run, cutoff), "start int, class string, s array<double>"
    )
    lists = "ord int, class array<string>, n array<bigint>, mean array<double>, ss array<double>, "
    lists += "low array<double>, high array<double>, over array<bigint>"
    whole = partials.repartition("start").mapInArrow(_merge(width, run, cutoff), lists)

    def entry(e: Column) -> Column:
        known = lambda v: F.when(e["n"] > 0, v)
        return F.struct(
            e["class"], e["n"], (e["n"] * e["mean"]).alias("total"), e["ss"],
            known(e["mean"]).alias("mean"), known(e["low"]).alias("low"), known(e["high"]).alias("high"), e["over"],
        )

    zipped = F.arrays_zip("class", "n", "mean", "ss", "low", "high", "over")
    return whole.select("ord", F.transform(zipped, entry).cast(ENTRY).alias("c"))


def matrix_moments(
    matrix: Matrix, samples: DataFrame | None = None, group: str | None = None, how: str = "inner"
) -> DataFrame:
    """vector_moments of the matrix, of the listed samples; how "left" keeps the others as class null."""
    vectors = matrix.vectors if samples is None else join_side(matrix.vectors, samples, "sample_id", how)
    return vector_moments(vectors, matrix.width, group)


def of_classes(moments: DataFrame) -> DataFrame:
    """The entries of named classes only."""
    return moments.withColumn("c", F.filter("c", lambda e: e["class"].isNotNull()))


def present(c: Column | str = "c") -> Column:
    """Number of values of a feature, all classes together."""
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, e: a + e["n"])
