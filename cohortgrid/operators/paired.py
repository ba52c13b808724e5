"""Markers whose value differs between the two samples of a pair, in many pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortgrid.cluster import durable, join_side, require_present, require_unique
from cohortgrid.fixed import NORMAL_TAG, SEX_AND_MITO, TUMOR_TAG
from cohortgrid.matrix import Matrix
from cohortgrid.operators.cohort import sorted_classes
from cohortgrid.operators.moments import vector_moments


def off_sex_and_mito(feature: str = "feature"):
    """True for features whose name has no sex or mitochondrial chromosome anywhere."""
    hit = F.lit(False)
    for name in SEX_AND_MITO:
        hit = hit | F.col(feature).contains(name)
    return ~hit


def pairs_of(tumors: DataFrame, group: str | None = None) -> DataFrame:
    """(sample_id, pair_id, side[, grp]): each listed sample and its partner, found by its name."""
    partner = F.replace(F.col("sample_id"), F.lit(TUMOR_TAG), F.lit(NORMAL_TAG))
    sides = F.array(
        F.struct(F.col("sample_id").alias("id"), F.lit("tumor").alias("side")),
        F.struct(partner.alias("id"), F.lit("normal").alias("side")),
    )
    grp = F.col(group) if group else F.lit("all")
    return tumors.select(
        F.col("sample_id").alias("pair_id"), grp.alias("grp"), F.inline(sides).alias("sample_id", "side")
    )


def pair_differences(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """tumor - normal per pair and feature: one scan and one shuffle, instead of joining cells to cells."""
    sided = join_side(cells, pairs, "sample_id")
    value = {s: F.max(F.when(F.col("side") == s, F.col("value"))) for s in ("tumor", "normal")}
    return sided.groupBy("grp", "pair_id", "feature").agg((value["tumor"] - value["normal"]).alias("diff"))


def vector_differences(matrix: Matrix, pairs: DataFrame) -> DataFrame:
    """(grp, diff): tumor - normal as a vector per pair. The two vectors of a pair meet; no cell travels by itself."""
    sided = join_side(matrix.vectors, pairs, "sample_id")
    side = {
        s: sided.where(F.col("side") == s).select("grp", "pair_id", F.col("x").alias(s)) for s in ("tumor", "normal")
    }
    both = side["tumor"].join(side["normal"], ["grp", "pair_id"])
    return both.select("grp", F.zip_with("tumor", "normal", lambda t, n: t - n).alias("diff"))


def per_group(values: dict[str, int]) -> Column:
    """Column: the value of the row's group, from a small table kept as a literal."""
    return F.element_at(F.create_map(*[F.lit(v) for item in values.items() for v in item]), F.col("grp"))


def occurrence(
    differences: DataFrame, pairs_in: dict[str, int], cutoff: float, key: str = "feature"
) -> DataFrame:
    """Pairs with a difference over the cutoff, per group and feature; NULL if any pair's is unknown."""
    counted = differences.groupBy("grp", key).agg(
        F.count_if(F.col("diff") > cutoff).alias("over"), F.count("diff").alias("known")
    )
    every = F.col("known") == per_group(pairs_in)
    return counted.select("grp", key, F.when(every, F.col("over")).alias("n_over"))


def vector_occurrence(differences: DataFrame, width: int, pairs_in: dict[str, int], cutoff: float) -> DataFrame:
    """occurrence by position (ord), from difference vectors."""
    moments = vector_moments(differences, width, "grp", "diff", cutoff)
    counted = moments.select("ord", F.inline("c")).withColumnRenamed("class", "grp")
    every = F.col("n") == per_group(pairs_in)
    return counted.select("grp", "ord", F.when(every, F.col("over")).alias("n_over"))


def top_with_ties(counts: DataFrame, k: int) -> DataFrame:
    """Per group, the features whose count reaches the k-th largest one (at least 1), ties included.

    The k-th largest is read off a histogram of the counts, which has at most one row per pair: the
    features themselves are never sorted or gathered. With fewer than k features, all with a count
    of 1 or more pass.
    """
    known = durable(counts.where(F.col("n_over") >= 1))
    histogram = known.groupBy("grp", "n_over").agg(F.count("*").alias("features"))
    from_top = Window.partitionBy("grp").orderBy(F.desc("n_over"))
    reached = histogram.withColumn("above", F.sum("features").over(from_top))
    kth = F.max(F.when(F.col("above") >= k, F.col("n_over")))
    bars = {r["grp"]: r["bar"] or 1 for r in reached.groupBy("grp").agg(kth.alias("bar")).collect()}
    return known.where(F.col("n_over") >= per_group(bars)) if bars else known


def paired_markers(
    data: Matrix | DataFrame,
    tumors: DataFrame,
    cutoff: float,
    k: int,
    group: str | None = None,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """(grp, feature, n_over) of the markers chosen from a matrix or from cells; with a group column, each
    group chooses its own. allowed(feature) restricts the candidates."""
    if group:
        sorted_classes(tumors, group)  # bounds the number of groups
        tumors = tumors.where(F.col(group).isNotNull())
    require_unique(tumors, "sample_id")  # two rows of a tumor would leave it without a partner
    pairs = pairs_of(tumors, group)
    known = data.vectors if isinstance(data, Matrix) else data
    require_present(pairs, known, "sample_id", "paired samples")
    totals = {r["grp"]: r["count"] for r in pairs.where("side = 'tumor'").groupBy("grp").count().collect()}
    if isinstance(data, Matrix):
        counts = data.named(vector_occurrence(vector_differences(data, pairs), data.width, totals, cutoff))
        counts = counts.where(off_sex_and_mito())
    else:
        counts = occurrence(pair_differences(data.where(off_sex_and_mito()), pairs), totals, cutoff)
    if allowed is not None:
        counts = join_side(counts, allowed, "feature", "left_semi")
    return top_with_ties(counts, k)


def marker_union(markers: DataFrame) -> DataFrame:
    return markers.select("feature").distinct()


def marker_difference(markers: DataFrame, unwanted: DataFrame) -> DataFrame:
    """Distinct markers that are not in the unwanted list."""
    return join_side(markers.select("feature").distinct(), unwanted.select("feature").distinct(), "feature", "left_anti")
