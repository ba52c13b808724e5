"""Line up annotation rows with matrix rows, and scores with annotation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortgrid.cluster import fits_broadcast, join_side, require_aligned, require_present
from cohortgrid.matrix import Matrix


def align_lenient(samples: DataFrame, matrix: Matrix, key: str = "sample_id") -> DataFrame:
    """Every sample with its vector x; a sample without a matrix row gets an all-NULL vector."""
    vectors = matrix.vectors.withColumnRenamed("sample_id", key)
    empty = F.array_repeat(F.lit(None).cast("double"), matrix.width)
    return samples.join(vectors, key, "left").withColumn("x", F.coalesce("x", empty))


def align_strict(samples: DataFrame, matrix: Matrix, key: str = "sample_id") -> DataFrame:
    """Every sample with its vector x; a sample without a matrix row raises, and so does a repeated one.

    When the annotation is small it is broadcast and the matrix is not shuffled.
    """
    vectors = matrix.vectors.withColumnRenamed("sample_id", key)
    require_aligned(samples, vectors, key)
    side = F.broadcast(samples) if fits_broadcast(samples) else samples
    return vectors.join(side, key).select(*[F.col(f"`{c}`") for c in samples.columns], "x")


def align_cells(samples: DataFrame, cells: DataFrame, key: str = "sample_id") -> DataFrame:
    """Cells of the listed samples with the annotation columns; an unknown sample raises."""
    require_present(samples, cells, key, "samples")
    return join_side(cells, samples, key)


def subset_features(cells: DataFrame, features: DataFrame) -> DataFrame:
    """Cells of the listed features; a listed feature absent from the data raises."""
    require_present(features, cells, "feature", "selected features")
    return join_side(cells, features.select("feature").distinct(), "feature", "left_semi")


def attach_scores(samples: DataFrame, scores: DataFrame, key: str = "sample_id") -> DataFrame:
    """All annotation rows and columns plus the score columns of the matching sample."""
    return samples.join(scores, key, "left")
