"""Column expressions on score arrays (one entry per class, classes in sorted order)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cohortgrid.fixed import SIGMOID_SHIFT, SIGMOID_SLOPE


def sigmoid(x: Column, slope: float = SIGMOID_SLOPE, shift: float = SIGMOID_SHIFT) -> Column:
    return 1 / (1 + F.exp(-slope * x + slope * shift))


def share_of_sum(scores: Column) -> Column:
    """Divide by the sum of the row; a row of zeros stays zeros."""
    total = F.aggregate(scores, F.lit(0.0), lambda acc, v: acc + v)
    divisor = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return F.transform(scores, lambda v: v / divisor)


def probabilities(scores: Column) -> Column:
    """Raw margins to class probabilities: sigmoid, then normalised per row."""
    return share_of_sum(F.transform(scores, lambda v: sigmoid(v)))


def top_ratio(scores: Column) -> Column:
    """Largest over second largest; infinite if the second is 0."""
    ranked = F.sort_array(scores, asc=False)
    second = F.element_at(ranked, 2)
    return F.when(second == 0, F.lit(float("inf"))).otherwise(F.element_at(ranked, 1) / second)


def top_label(scores: Column, classes: list[str]) -> Column:
    """Name of the class with the largest score; the first in class order wins a tie."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))
