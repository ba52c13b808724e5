"""One query for each operator over the driver tables, and SQL where it can state the rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortgrid.llm import bpe
from cohortgrid.llm.chat import repaired
from cohortgrid.llm.decontamination import contaminated
from cohortgrid.llm.fingerprints import compared_with_edits
from cohortgrid.llm.jaccard_join import similar_components
from cohortgrid.llm.labelled import clean_labels, remainder
from cohortgrid.llm.lexical_search import ranked_documents
from cohortgrid.llm.pii import KINDS, find_pii, spans_text
from cohortgrid.llm.quality import fit_quality, quality_scores
from cohortgrid.llm.sharding import shuffled_shards
from cohortgrid.llm.spelling import corpus_words, variant_forms
from cohortgrid.llm.substring_dedup import without_repeats
from cohortgrid.llm.toxicity import ToxicityModel, fit_toxicity, toxicity_scores
from cohortgrid.llm.url_filters import judge_urls

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    return similar_components(table(spark, sf_dir, "documents"), ngram=3, num=90, den=100)


@query
def op3_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query
def op9_bpe(spark, sf_dir):
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY), VOCABULARY)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_benchmark_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LLM_ORACLES["op3_url_filters"] = """
WITH rules(host, path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS host, coalesce(rest, '') AS rest FROM rest),
parsed AS (SELECT page_id,
  translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM cut),
places AS (SELECT DISTINCT host, path FROM parsed),
best AS (SELECT p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
    arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM places p JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
  GROUP BY p.host, p.path)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM parsed LEFT JOIN best USING (host, path)
"""


@query
def op2_substring_dedup(spark, sf_dir):
    cut = without_repeats(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.sha2("kept", 256), "whole_sha256").alias("kept_sha256")
    return cut.select("doc_id", "n_words", "n_removed", kept)


@query
def op4_document_fingerprints(spark, sf_dir):
    compared = compared_with_edits(table(spark, sf_dir, "documents"))
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


TOXIC_FOLD, TOXIC_FOLDS = 0, 5
QUALITY_FOLD, QUALITY_FOLDS = 2, 4


def toxicity_model(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    return fit_toxicity(documents, clean_labels(labels, "toxic", remainder(TOXIC_FOLDS) != TOXIC_FOLD))


@query
def op5_chat_formatting(spark, sf_dir):
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query
def op6_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    scores = toxicity_scores(documents, toxicity_model(documents, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder(TOXIC_FOLDS) == TOXIC_FOLD, F.lit(False)).alias("held_out")
    return scores.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_quality_classifier(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    labels = clean_labels(table(spark, sf_dir, "labels"), "quality", remainder(QUALITY_FOLDS) != QUALITY_FOLD)
    scores = quality_scores(documents, fit_quality(documents, labels))
    held_out = F.coalesce(remainder(QUALITY_FOLDS) == QUALITY_FOLD, F.lit(False)).alias("held_out")
    return scores.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op7_pii(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [
        F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)
    ]
    base = F.sha2(spans_text(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, spans_text(F.col("spans")).alias("spans"))


SLIP = 31


@query
def op11_spelling_variants(spark, sf_dir):
    words = corpus_words(table(spark, sf_dir, "documents"), least_letters=7, least_count=2, slip=SLIP)
    return variant_forms(words, ratio=10)


@query
def op12_ranked_search(spark, sf_dir):
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


LLM_ORACLES["op12_ranked_search"] = r"""
WITH low AS (SELECT row_number() OVER () AS row, doc_id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT row, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
counts AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT row, sum(tf)::BIGINT AS n FROM counts GROUP BY row),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
means AS (SELECT row, 100 - 75 + (75 * n * docs) // terms AS m FROM lengths, corpus),
asked AS (SELECT row_number() OVER () AS item, item_id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark),
item_words AS (SELECT item, item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM asked),
item_terms AS (SELECT item, item_id, term, count(*) AS times FROM item_words GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, corpus WHERE term IN (SELECT term FROM item_terms) GROUP BY term),
scores AS (SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM item_terms JOIN weights USING (term) JOIN counts USING (term) JOIN means USING (row)
  GROUP BY item, item_id, row, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""

SHARDS = 8


@query
def op13_sharding(spark, sf_dir):
    placed = shuffled_shards(table(spark, sf_dir, "documents"), SHARDS)
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
