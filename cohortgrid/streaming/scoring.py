"""Score samples as their vectors arrive, with a model fitted before. Row-local: no state, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cohortgrid.operators.linear import LinearModel
from cohortgrid.operators.probability import with_probabilities
from cohortgrid.operators.reduce import Reduction


def score_arriving(vectors: DataFrame, model: LinearModel, reduction: Reduction | None = None) -> DataFrame:
    """vectors(sample_id, x, ...) as a stream or a batch -> class probabilities, ratio and label; a binary
    model adds its raw score."""
    if reduction is not None:
        vectors = vectors.withColumn("x", reduction.project("x"))
    if len(model.classes) == 1:
        return vectors.withColumn("score", model.score("x")).drop("x")
    return with_probabilities(vectors.withColumn("scores", model.scores("x")).drop("x"), list(model.classes))


def write_arriving(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scored samples to a Parquet folder, each exactly once; stops when the input is used up."""
    return (
        scored.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
