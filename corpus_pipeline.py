"""The corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortgrid.llm import bpe
from cohortgrid.llm.common import keep_ids, small, written
from cohortgrid.llm.decontamination import without_contaminated
from cohortgrid.llm.jaccard_join import similar_components
from cohortgrid.llm.labelled import below, clean_labels
from cohortgrid.llm.pii import masked
from cohortgrid.llm.queries import VOCABULARY
from cohortgrid.llm.toxicity import fit_toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

ORACLE_SQL = None  # the classifier's decisions have no SQL


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go, each row by its own text; a null text is an empty one. The classifier learns
    from all labels of documents in docs."""
    labels = clean_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", F.lit(True))
    return below(docs, fit_toxicity(docs, labels).scorer, 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) one document stays: the one with the smallest doc_id.

    A document is a row. Rows whose doc_id is null or stands for several rows get numbers above all doc_ids here, so
    that each is judged by its own text; next to them, documents with an id of their own stay. Documents without words
    are no copies.
    """
    twice = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    twice = written(twice.select(F.col("doc_id").alias("odd_id")))
    if twice.isEmpty():
        return keep_ids(docs, _others(docs.select("doc_id", "text")), "doc_id", "left_anti").select(docs.columns)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id")  # keeps all names apart
    marked = rows.join(F.broadcast(twice) if small(twice) else twice, rows["doc_id"].eqNullSafe(twice["odd_id"]), "left")
    plain = marked.where("odd_id IS NULL AND doc_id IS NOT NULL").select("row.*")
    last = docs.agg(F.max("doc_id")).first()[0]
    number = F.lit(max(-1, -1 if last is None else last) + 1) + F.monotonically_increasing_id()
    odd = written(marked.where("odd_id IS NOT NULL OR doc_id IS NULL").select("row", number.alias("number")))
    others = _others(
        plain.select("doc_id", "text").unionByName(odd.select(F.col("number").alias("doc_id"), "row.text"))
    )
    kept = keep_ids(plain, others, "doc_id", "left_anti").select(docs.columns)
    kept_odd = keep_ids(odd, others.withColumnRenamed("doc_id", "number"), "number", "left_anti").select("row.*")
    return kept.unionByName(kept_odd)


def _others(texts: DataFrame) -> DataFrame:
    """(doc_id): all but the first document of each group of near copies."""
    return written(similar_components(texts).where("doc_id <> component_id").select("doc_id").distinct())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an occurrence of a benchmark window go, each row by its own text."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows. Rows stay as many; a null text stays null."""
    return masked(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids as little-endian unsigned 32-bit integers, and their number; a row for each row. A null
    text has no ids."""
    coded = bpe.encode(docs, VOCABULARY)
    return coded.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
