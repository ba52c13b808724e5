"""The studies from files to files: read the inputs, run the study, write its table."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from cohortgrid import fixed
from cohortgrid.matrix import Matrix
from cohortgrid.plans import studies
from cohortgrid.sources import files


def _cohort(spark: SparkSession, path: str):
    return files.read_annotation(spark, path)


def _matrix(spark: SparkSession, path: str, strict: bool = False) -> Matrix:
    """The studies read the matrix several times: its text is parsed once."""
    return files.read_matrix(spark, path, strict).written()


def detect(spark: SparkSession, samples: str, split: str, matrix: str, out: str, mode: str = "error") -> None:
    """Cancer score of the test samples."""
    table = studies.detection(_cohort(spark, samples), _matrix(spark, matrix), split)
    files.write_predictions(table, out, mode)


def surveil(spark: SparkSession, samples: str, split: str, matrix: str, out: str, mode: str = "error") -> None:
    """Liver cancer score of the test samples."""
    table = studies.surveillance(_cohort(spark, samples), _matrix(spark, matrix), split)
    files.write_predictions(table, out, mode)


def type_cancers(spark: SparkSession, samples: str, split: str, matrix: str, out: str, mode: str = "error") -> None:
    """Cancer type of the cancer samples among the test samples."""
    table = studies.typing(_cohort(spark, samples), _matrix(spark, matrix), split)
    files.write_predictions(table, out, mode)


def predict_race(
    spark: SparkSession, samples: str, split: str, matrix: str, features: str, out: str, mode: str = "error"
) -> None:
    listed = files.read_feature_list(spark, features, stripped=False)
    table = studies.race(_cohort(spark, samples), _matrix(spark, matrix), split, listed)
    files.write_predictions(table, out, mode)


def predict_disease(
    spark: SparkSession,
    samples: str,
    sample_column: str,
    class_column: str,
    split: str,
    matrix: str,
    features: str,
    out: str,
    reduction: str = "none",
    scaling: str = "standardize",
    classifier: str = fixed.OVR_CLASSIFIER,
    mode: str = "error",
) -> None:
    annotation = files.read_annotation(spark, samples, strict=True)
    data = _matrix(spark, matrix, strict=True)
    listed = files.read_feature_list(spark, features)
    table = studies.disease(
        annotation, data, split, listed, sample_column, class_column, reduction, scaling, classifier
    )
    files.write_predictions(table, out, mode)


def deconvolve(
    spark: SparkSession, profiles: str, matrix: str, out: str, mode: str = "error", estimate: str = "posterior_mean"
) -> None:
    """Tissue fractions of every sample of the matrix."""
    known, tissues = files.read_profiles(spark, profiles)
    data = _matrix(spark, matrix)
    files.write_fractions(studies.deconvolution(data, known, tissues, estimate), out, mode)


def discover_tissue_markers(
    spark: SparkSession,
    study: str,
    samples: str,
    matrix: str,
    out: str,
    cutoff: float,
    k: int,
    by_type: bool = False,
    mode: str = "error",
) -> None:
    data = _matrix(spark, matrix)
    files.write_markers(studies.discover_paired(study, _cohort(spark, samples), data, cutoff, k, by_type), out, mode)


def discover_plasma_markers(
    spark: SparkSession,
    study: str,
    samples: str,
    matrix: str,
    out: str,
    split: str,
    cutoff: float,
    per_class: int,
    unwanted: str | None = None,
    mode: str = "error",
) -> None:
    left_out = spark.read.text(unwanted).select(F.col("value").alias("feature")) if unwanted else None
    data = _matrix(spark, matrix)
    markers = studies.discover_one_vs_rest(study, _cohort(spark, samples), data, split, cutoff, per_class, left_out)
    files.write_markers(markers, out, mode)
