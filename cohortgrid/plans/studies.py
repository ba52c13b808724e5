"""The studies end to end, from DataFrames to a prediction or marker table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortgrid import fixed
from cohortgrid.cluster import durable, join_side, require_aligned, require_present, require_unique
from cohortgrid.matrix import Matrix
from cohortgrid.operators import cohort, contrasts, mixture, paired, quality
from cohortgrid.operators.align import align_strict
from cohortgrid.operators.linear import fit_binary, fit_one_vs_rest
from cohortgrid.operators.moments import matrix_moments, of_classes, present
from cohortgrid.operators.probability import with_probabilities
from cohortgrid.operators.reduce import reduce_by_spec, reduce_if_wider


def binary_study(samples: DataFrame, matrix: Matrix, split: str, components: int, score: str) -> DataFrame:
    """Normal against cancer: the test samples with all their columns and the raw score appended."""
    cohort.require_both_sides(samples, split, any_case=False)
    train_x, test_x = cohort.split_exact(align_strict(cohort.with_split(samples, split), matrix), split)
    train_x, test_x, width = reduce_if_wider(train_x, test_x, matrix.width, components)
    model = fit_binary(train_x.withColumn("label", cohort.status_code()), width)
    return test_x.select(*[F.col(f"`{c}`") for c in samples.columns], model.score("x").alias(score))


def detection(samples: DataFrame, matrix: Matrix, split: str) -> DataFrame:
    return binary_study(samples, matrix, split, fixed.DETECTION_COMPONENTS, fixed.DETECTION_SCORE)


def surveillance(samples: DataFrame, matrix: Matrix, split: str) -> DataFrame:
    return binary_study(samples, matrix, split, fixed.SURVEILLANCE_COMPONENTS, fixed.SURVEILLANCE_SCORE)


def _one_vs_rest(
    samples: DataFrame, matrix: Matrix, split: str, column: str, label: str, components: int | None
) -> DataFrame:
    cohort.require_both_sides(samples, split, any_case=False)
    classes = cohort.sorted_classes(samples, column)
    train_x, test_x = cohort.split_exact(align_strict(cohort.with_split(samples, split), matrix), split)
    width = matrix.width
    if components:
        train_x, test_x, width = reduce_if_wider(train_x, test_x, width, components)
    model = fit_one_vs_rest(train_x.withColumn("code", cohort.class_code(column, classes)), width, classes)
    scored = test_x.withColumn("scores", model.scores("x")).drop("x")
    return with_probabilities(scored, classes, label=label)


def typing(samples: DataFrame, matrix: Matrix, split: str) -> DataFrame:
    """Cancer type of the cancer samples: all columns, one probability per type, ratio and label."""
    cancers = cohort.without_class(samples)
    return _one_vs_rest(cancers, matrix, split, fixed.CANCER_TYPE, fixed.PRED_LABEL, fixed.TYPING_COMPONENTS)


def race(samples: DataFrame, matrix: Matrix, split: str, features: list[str]) -> DataFrame:
    """Race from a list of features, without reduction."""
    return _one_vs_rest(samples, matrix.project(features), split, fixed.RACE, fixed.RACE_PRED_LABEL, None)


def disease(
    samples: DataFrame,
    matrix: Matrix,
    split: str,
    features: list[str],
    sample_column: str = fixed.SAMPLE_ID,
    class_column: str = fixed.DISEASE_TYPE,
    reduction: str = "none",
    scaling: str = "standardize",
    classifier: str = fixed.OVR_CLASSIFIER,
) -> DataFrame:
    """Disease class of the test samples: id, true and predicted label, ratio, one probability per class."""
    column, test_value = cohort.parse_split(split, strict=True)
    cohort.require_columns(samples, [column, sample_column, class_column])
    classes = cohort.sorted_classes(samples, class_column)
    chosen = matrix.project(features)
    coded = samples.select(
        F.col(f"`{sample_column}`").alias("sample_id"),
        cohort.class_code(class_column, classes).alias("code"),
        F.col(f"`{column}`").alias("split"),
    )
    cohort.require_both_sides(coded, f"split:{test_value}")
    train_x, test_x = cohort.split_any_case(align_strict(coded, chosen), f"split:{test_value}")
    train_x, test_x, width = reduce_by_spec(train_x, test_x, chosen.width, reduction, scaling)
    model = fit_one_vs_rest(train_x, width, classes, classifier=classifier)
    names = F.array(*[F.lit(c) for c in classes])
    scored = test_x.select(
        F.col("sample_id").alias(sample_column),
        F.element_at(names, F.col("code") + 1).alias(fixed.TRUE_LABEL),
        model.scores("x").alias("scores"),
    )
    table = with_probabilities(scored, classes)
    first = [sample_column, fixed.TRUE_LABEL, fixed.PRED_LABEL, fixed.RATIO]
    return table.select(*[F.col(f"`{c}`") for c in [*first, *classes]])


def discover_paired(
    study: str, tumors: DataFrame, data: Matrix | DataFrame, cutoff: float, k: int, by_type: bool = False
) -> DataFrame:
    """Marker set of the tissue studies, from a matrix or from cells.

    Features that lack half or more of all samples of the data are left out.

    By default every cancer type chooses from all tumors, so one choice serves all types; with by_type,
    each of the study's types chooses from its own tumors.
    """
    types = {fixed.STUDY_DETECTION: fixed.CANCER_TYPES, fixed.STUDY_LIVER_CANCER: fixed.LIVER_TYPES}
    if study not in types:
        raise ValueError(f"not a tissue study: {study}")
    known = tumors.where(F.col(fixed.CANCER_TYPE).isNotNull())
    if by_type:
        known = known.where(F.col(fixed.CANCER_TYPE).isin(*types[study]))
    group = fixed.CANCER_TYPE if by_type else None
    markers = paired.paired_markers(data, known, cutoff, k, group, _half_present(data))
    return paired.marker_union(markers)


def _half_present(data: Matrix | DataFrame) -> DataFrame:
    """Names of the features that more than half of all samples have; a repeated sample raises."""
    if not isinstance(data, Matrix):
        total = data.select("sample_id").distinct().count()
        return durable(quality.missingness(data, total).where("kept").select("feature"))
    require_unique(data.vectors, "sample_id")
    flags = quality.feature_missingness(matrix_moments(data), data.vectors.count()).where("kept")
    return durable(data.named(flags).select("feature"))


def discover_one_vs_rest(
    study: str,
    samples: DataFrame,
    data: Matrix | DataFrame,
    split: str,
    cutoff: float = fixed.MARKER_DIFF_CUTOFF,
    per_class: int = fixed.MARKERS_PER_CLASS,
    unwanted: DataFrame | None = None,
) -> DataFrame:
    """Marker set of the plasma studies, from the training samples of a matrix or of cells; the race study
    leaves out the markers of an unwanted list. Features without half of all samples are left out first."""
    columns = {fixed.STUDY_LIVER_DISEASE: fixed.DISEASE_TYPE, fixed.STUDY_RACE: fixed.RACE}
    if study not in columns:
        raise ValueError(f"not a plasma study: {study}")
    cohort.require_both_sides(samples, split, any_case=False)
    train, _ = cohort.split_exact(samples, split)
    annotation = train.select("sample_id", F.col(columns[study]).cast("string").alias("class"))
    classes = cohort.sorted_classes(annotation, "class")
    if isinstance(data, Matrix):
        require_aligned(annotation, data.vectors, "sample_id")
        require_unique(data.vectors, "sample_id")
        # One pass: samples outside the training set are a class of their own, which counts as present only.
        everything = matrix_moments(data, annotation, "class", "left")
        kept = everything.where(quality.kept_if_present(present("c"), data.vectors.count()))
        profile = contrasts.residuals(data.named(contrasts.complete(of_classes(kept), classes)))
        table = contrasts.profile_effects(profile, annotation, classes)
    else:
        require_present(annotation, data, "sample_id", "samples")
        allowed = _half_present(data)
        table = join_side(contrasts.effects_table(data, annotation, classes), allowed, "feature", "left_semi")
    markers = paired.marker_union(contrasts.top_markers(table, cutoff, per_class))
    if study == fixed.STUDY_RACE:
        if unwanted is None:
            raise ValueError("the race study needs the list of markers to leave out")
        markers = paired.marker_difference(markers, unwanted)
    return markers


def deconvolution(
    data: Matrix | DataFrame, profiles: DataFrame, tissues: list[str], mode: str = "posterior_mean"
) -> DataFrame:
    """Tissue fractions of every sample; a repeated sample, cell or profile raises."""
    require_unique(profiles, "feature")
    if isinstance(data, Matrix):
        require_unique(data.vectors, "sample_id")
    return mixture.deconvolve(data, profiles, tissues, mode)
