"""Bounded samples of labelled documents, and a logistic curve through scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortgrid.llm.common import slices


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def clean_labels(labels: DataFrame, column: str, usable: Column) -> DataFrame:
    """(doc_id, label), one row for each usable doc_id with a label 0 or 1; of several labels the larger holds."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & usable)
    return rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))


def sampled(documents: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of up to per_class documents of either label, and all counts by label.

    The ids are picked by their hash before any text is read. Of several rows of an id the smallest text counts.
    """
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    picked = None
    for label in (0, 1):
        some = labels.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return rows, {k: counts.get(k, 0) for k in (0, 1)}


def sample(documents: DataFrame, labels: DataFrame, per_class: int) -> tuple[pd.DataFrame, dict[int, int]]:
    """sampled on the driver, by doc_id: 2 * per_class texts at most."""
    rows, counts = sampled(documents, labels, per_class)
    return rows.toPandas().sort_values("doc_id", ignore_index=True), counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 50) -> np.ndarray:
    """Weights of a dense logistic regression of targets 0..1 by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def scored(documents: DataFrame, score) -> DataFrame:
    """documents' doc_id with score(text) in a column "score", a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = score()
        for batch in slices(batches, 512):
            rates = [float(rate(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rates, pa.float64())], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, score double")


def below(documents: DataFrame, score, bound: float) -> DataFrame:
    """The rows of documents whose text scores under bound; judged row by row, whatever the id. All columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = score()
        for batch in slices(batches, 512):
            yield batch.filter(pa.array([rate(t or "") < bound for t in batch.column("text").to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
