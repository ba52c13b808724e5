"""Class margins to the columns of a prediction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortgrid.fixed import PRED_LABEL, RATIO
from cohortgrid.functions.scores import probabilities, top_label, top_ratio


def class_columns(scored: DataFrame, classes: list[str], scores: str = "scores") -> DataFrame:
    """Spread an array in class order into one column per class; the array is dropped."""
    spread = [F.element_at(scores, i + 1).alias(c) for i, c in enumerate(classes)]
    kept = [F.col(f"`{c}`") for c in scored.columns if c != scores]
    return scored.select(*kept, *spread)


def reorder_scores(scores: str, model_classes: list[str], classes: list[str]):
    """Column: the score array in another class order; a class the model does not know raises."""
    unknown = [c for c in classes if c not in model_classes]
    if unknown:
        raise ValueError(f"classes not seen by the model: {unknown}")
    return F.array(*[F.element_at(scores, model_classes.index(c) + 1) for c in classes])


def with_probabilities(
    scored: DataFrame, classes: list[str], scores: str = "scores", label: str = PRED_LABEL
) -> DataFrame:
    """Replace raw margins by probability columns, followed by ratio and label."""
    p = scored.withColumn(scores, probabilities(F.col(scores)))
    p = p.withColumn(RATIO, top_ratio(F.col(scores))).withColumn(label, top_label(F.col(scores), classes))
    own = [c for c in scored.columns if c != scores]
    wide = class_columns(p, classes, scores)
    return wide.select(*[F.col(f"`{c}`") for c in [*own, *classes, RATIO, label]])
