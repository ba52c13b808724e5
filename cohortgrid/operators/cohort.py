"""Splits, labels, class counts and class weights of the sample annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortgrid.fixed import NORMAL, STATUS, STATUS_CODES
from cohortgrid.matrix import quoted

MAX_CLASSES = 1000


def parse_split(spec: str, strict: bool = False) -> tuple[str, str]:
    """"<column>:<test value>". Text from a second colon on is ignored, or refused if strict; strict also refuses
    an empty name or value."""
    column, colon, rest = spec.partition(":")
    value, more, _ = rest.partition(":")
    if not colon or (strict and (more or not column or not value)):
        raise ValueError(f"a split names a column and its test value, as in part:test; got {spec!r}")
    return column, value


def require_columns(samples: DataFrame, columns: list[str]) -> None:
    absent = [c for c in columns if c not in samples.columns]
    if absent:
        raise ValueError(f"columns not in the annotation: {absent}")


def split_exact(samples: DataFrame, spec: str) -> tuple[DataFrame, DataFrame]:
    """(train, test), case-sensitive; a sample without a split value is in neither."""
    column, test_value = parse_split(spec)
    require_columns(samples, [column])
    col = F.col(quoted(column)).cast("string")
    return samples.where(col != test_value), samples.where(col == test_value)


def with_split(samples: DataFrame, spec: str) -> DataFrame:
    """Samples that are in train or in test of the exact split."""
    column, _ = parse_split(spec)
    require_columns(samples, [column])
    return samples.where(F.col(quoted(column)).isNotNull())


def is_test_any_case(column: str, test_value: str) -> Column:
    return F.lower(F.coalesce(F.col(quoted(column)).cast("string"), F.lit("nan"))) == test_value.lower()


def split_any_case(samples: DataFrame, spec: str) -> tuple[DataFrame, DataFrame]:
    """(train, test), ignoring case; a sample without a split value trains."""
    column, test_value = parse_split(spec, strict=True)
    require_columns(samples, [column])
    is_test = is_test_any_case(column, test_value)
    return samples.where(~is_test), samples.where(is_test)


def require_both_sides(samples: DataFrame, spec: str, any_case: bool = True) -> None:
    """Raise if the split, by either rule, leaves train or test empty."""
    column, test_value = parse_split(spec, strict=any_case)
    require_columns(samples, [column])
    col = F.col(quoted(column)).cast("string")
    is_test = is_test_any_case(column, test_value) if any_case else col == test_value
    counts = samples.agg(F.count_if(is_test).alias("test"), F.count_if(~is_test).alias("training")).first().asDict()
    for side, n in counts.items():
        if not n:
            raise ValueError(f"the split {spec!r} leaves no {side} samples")


def without_class(samples: DataFrame, column: str = STATUS, name: str = NORMAL) -> DataFrame:
    """Drop one class; rows without a class go too."""
    return samples.where(F.col(quoted(column)) != name)


def status_code(column: str = STATUS) -> Column:
    """normal -> 0, cancer -> 1, other text -> NULL."""
    col = F.col(quoted(column))
    code = F.lit(None).cast("int")
    for name, value in STATUS_CODES.items():
        code = F.when(col == name, F.lit(value)).otherwise(code)
    return code


def sorted_classes(samples: DataFrame, column: str) -> list[str]:
    """Sorted distinct class names; code-point order."""
    rows = samples.select(F.col(quoted(column)).cast("string").alias("c")).where("c IS NOT NULL").distinct()
    names = sorted(r["c"] for r in rows.take(MAX_CLASSES + 1))
    if len(names) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {column}: not a class column")
    return names


def class_code(column: str, classes: list[str]) -> Column:
    """Position of the class in the sorted class list; an unlisted class raises."""
    col = F.col(quoted(column)).cast("string")
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), col)
    unknown = F.raise_error(F.concat(F.lit("class not in the class list: "), F.coalesce(col, F.lit("NULL"))))
    return F.when(position > 0, (position - 1).cast("int")).otherwise(unknown.cast("int"))


def class_frequency(samples: DataFrame, column: str) -> DataFrame:
    return samples.groupBy(F.col(quoted(column)).alias("class")).agg(F.count("*").alias("n"))


def split_counts(samples: DataFrame, spec: str, column: str, any_case: bool = False) -> DataFrame:
    """Train and test samples per class; a class absent from one side counts 0 there."""
    split, test_value = parse_split(spec)
    col = F.col(quoted(split)).cast("string")
    if any_case:
        is_test = is_test_any_case(split, test_value)
        is_train = ~is_test
    else:
        is_test, is_train = col == test_value, col != test_value
    return samples.groupBy(F.col(quoted(column)).alias("class")).agg(
        F.count_if(is_train).alias("n_train"), F.count_if(is_test).alias("n_test")
    )


def balanced_weights(train: DataFrame, column: str) -> DataFrame:
    """N / (K * n_class) over the training rows; the window runs over the K counts only."""
    counts = class_frequency(train.where(F.col(quoted(column)).isNotNull()), column)
    everything = Window.partitionBy(F.lit(1))
    return counts.select(
        "class",
        "n",
        (F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))).alias("weight"),
    )
