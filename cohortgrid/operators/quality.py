"""Per-feature quality: missingness, near-zero variance, location and scale."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cohortgrid.cluster import durable, join_side
from cohortgrid.fixed import MISSING_SHARE, NZV_FREQ_RATIO, NZV_UNIQUE_PERCENT
from cohortgrid.matrix import Matrix
from cohortgrid.operators.moments import present
from cohortgrid.operators.partials import dense, list_column

HASH_WORDS = 16  # of 64 hash buckets each
LOOK = 4


def missingness(cells: DataFrame, total: int, key: str = "feature") -> DataFrame:
    """Missing cells per key out of a dense grid of `total` cells, and whether the key is kept.

    A cell that has no row counts as missing, so nothing has to be filled in first. All-missing keys and
    keys with a missing share of one half or more are not kept.
    """
    counted = cells.groupBy(key).agg(F.count("value").alias("n_present"))
    n = F.col("n_present")
    return counted.select(key, (F.lit(total) - n).alias("n_missing"), kept_if_present(n, total).alias("kept"))


def kept_if_present(n_present: Column, total: int) -> Column:
    """Whether a key with so many of `total` cells is kept: some, and more than half."""
    return (n_present > 0) & (F.lit(total) - n_present < MISSING_SHARE * total)


def feature_missingness(moments: DataFrame, total: int) -> DataFrame:
    """missingness by position (ord), from moments.vector_moments of `total` vectors."""
    n = present("c")
    return moments.select("ord", (F.lit(total) - n).alias("n_missing"), kept_if_present(n, total).alias("kept"))


def feature_scaler(moments: DataFrame, kind: str = "sample") -> DataFrame:
    """scaler by position (ord), from moments.vector_moments without classes."""
    e = F.get("c", F.lit(0))
    spread = F.sqrt(e["ss"] / (e["n"] - (1 if kind == "sample" else 0)))
    if kind == "sample":
        sd = F.when(e["n"] > 1, spread)
    elif kind == "population":
        sd = F.when(e["n"] > 0, F.when(e["low"] == e["high"], F.lit(1.0)).otherwise(spread))
    elif kind in ("center", "none"):
        sd = F.lit(1.0)
    else:
        raise ValueError(f"unknown scaling: {kind}")
    return moments.select("ord", (F.lit(0.0) if kind == "none" else e["mean"]).alias("mean"), sd.alias("sd"))


def drop_features(matrix: Matrix, flags: DataFrame) -> Matrix:
    """The matrix with the features that feature_missingness keeps, in their order; row-local but for the flags."""
    kept = set(flags.where("kept").select("ord").toArrow().column("ord").to_pylist())
    return matrix.project([name for at, name in enumerate(matrix.names()) if at in kept])


def sample_missingness(matrix: Matrix) -> DataFrame:
    """missingness per sample; row-local."""
    n = F.size(F.filter("x", lambda v: v.isNotNull())).cast("long")
    missing = (F.lit(matrix.width) - n).alias("n_missing")
    return matrix.vectors.select("sample_id", missing, kept_if_present(n, matrix.width).alias("kept"))


def drop_empty_samples(matrix: Matrix) -> Matrix:
    """Drop samples whose every value is missing; row-local."""
    some = matrix.vectors.where(F.exists("x", lambda v: v.isNotNull()))
    return Matrix(some, matrix.width, matrix.listed, matrix.table)


def standardize_matrix(matrix: Matrix, scale: DataFrame) -> Matrix:
    """standardize for vectors, with a fitted feature_scaler; features that it lacks become NULL. Row-local."""
    width = matrix.width
    fitted = scale.select("ord", "mean", "sd").toArrow()
    mean, sd = np.full(width, np.nan), np.full(width, np.nan)
    at = fitted.column("ord").to_numpy()
    mean[at], sd[at] = fitted.column("mean").to_numpy(), fitted.column("sd").to_numpy()
    sd[sd == 0] = np.nan

    @F.arrow_udf(ArrayType(DoubleType()))
    def scaled(column: pa.Array) -> pa.Array:
        z = (dense(column, width) - mean) / sd
        ends = pa.array(np.arange(0, z.size + 1, width, dtype=np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(z.ravel(), mask=np.isnan(z).ravel()))

    return Matrix(matrix.vectors.select("sample_id", scaled("x").alias("x")), width, matrix.listed, matrix.table)


def fill_missing(matrix: Matrix, scale: DataFrame) -> Matrix:
    """Missing values become the mean of their feature in a fitted feature_scaler, or 0 where it has none. Row-local."""
    width = matrix.width
    fitted = scale.where("mean IS NOT NULL").select("ord", "mean").toArrow()
    mean = np.zeros(width)
    mean[fitted.column("ord").to_numpy()] = fitted.column("mean").to_numpy()

    @F.arrow_udf(ArrayType(DoubleType()))
    def filled(column: pa.Array) -> pa.Array:
        x = dense(column, width)
        return list_column(np.where(np.isnan(x), mean, x))

    return Matrix(matrix.vectors.select("sample_id", filled("x").alias("x")), width, matrix.listed, matrix.table)


def drop_half_missing(cells: DataFrame, total: int, key: str = "feature") -> DataFrame:
    kept = durable(missingness(cells, total, key).where("kept").select(key))
    return join_side(cells, kept, key, "left_semi")


def drop_all_missing(cells: DataFrame, key: str = "sample_id") -> DataFrame:
    """Drop keys whose every value is missing."""
    some = durable(cells.groupBy(key).agg(F.count("value").alias("n")).where("n > 0").select(key))
    return join_side(cells, some, key, "left_semi")


def near_zero_variance(
    cells: DataFrame,
    total: int,
    freq_ratio: float = NZV_FREQ_RATIO,
    unique_percent: float = NZV_UNIQUE_PERCENT,
    key: str = "feature",
) -> DataFrame:
    """Flag features with one distinct value, or with a dominating value and few distinct ones.

    Counts are folded twice before a feature's values meet: (feature, value) -> count, then
    (feature, count) -> how many values have it. A feature of n samples has at most sqrt(2n) different
    counts, so the list gathered per feature stays short however many cells it has.
    """
    by_value = cells.groupBy(key, "value").agg(F.count("*").alias("times"))
    by_times = by_value.groupBy(key, "times").agg(F.count("value").alias("values"))
    pair = F.when(F.col("values") > 0, F.struct("times", "values"))
    folded = by_times.groupBy(key).agg(
        F.sort_array(F.collect_list(pair), asc=False).alias("t"),
        F.sum("values").alias("n_distinct"),
    )
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    ratio = (
        F.when(F.col("n_distinct") < 2, F.lit(0.0))
        .when(first["values"] > 1, F.lit(1.0))
        .otherwise(first["times"] / second["times"])
    )
    percent = 100.0 * F.col("n_distinct") / F.lit(float(total))
    measured = folded.select(key, ratio.alias("freq_ratio"), percent.alias("percent_unique"), "n_distinct")
    low = (F.col("freq_ratio") > freq_ratio) & (F.col("percent_unique") <= unique_percent)
    return measured.withColumn("near_zero", (F.col("n_distinct") <= 1) | low)


def varying(
    cells: DataFrame,
    total: int,
    freq_ratio: float = NZV_FREQ_RATIO,
    unique_percent: float = NZV_UNIQUE_PERCENT,
    key: str = "feature",
) -> DataFrame:
    """Keys that near_zero_variance does not flag, with values counted for the doubtful ones only.

    One aggregate settles most keys: equal extremes are one distinct value; a key with freq_ratio + 1 values
    or fewer cannot have a value dominate that much; and a key whose values fall in more hash buckets than
    the flag allows distinct values has too many. Buckets fill up beyond 100 * 64 * HASH_WORDS samples; keys
    are then doubtful and their values are counted.
    """
    hashed = cells.select(key, "value", F.when(F.col("value").isNotNull(), F.xxhash64(F.col("value") + 0.0)).alias("_h"))
    bit = F.expr("shiftleft(1L, CAST(_h & 63 AS INT))")
    word = F.pmod(F.shiftright("_h", 6), F.lit(HASH_WORDS))
    marks = [F.bit_or(F.when(word == w, bit)).alias(f"_m{w}") for w in range(HASH_WORDS)]
    extent = hashed.groupBy(key).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("present"), *marks
    )
    buckets = sum((F.coalesce(F.bit_count(f"_m{w}"), F.lit(0)) for w in range(HASH_WORDS)), F.lit(0))
    many = (F.col("present") <= freq_ratio + 1) | (100.0 * buckets / F.lit(float(total)) > unique_percent)
    settled = durable(extent.where("low < high").select(key, many.alias("many")))
    doubtful = settled.where("NOT many").select(key)
    counted = near_zero_variance(join_side(cells, doubtful, key, "left_semi"), total, freq_ratio, unique_percent, key)
    return settled.where("many").select(key).unionByName(counted.where("NOT near_zero").select(key))


def varying_features(
    vectors: DataFrame,
    moments: DataFrame,
    total: int,
    freq_ratio: float = NZV_FREQ_RATIO,
    unique_percent: float = NZV_UNIQUE_PERCENT,
) -> DataFrame:
    """varying by position (ord), for the vectors(sample_id, x) of which moments are given.

    The moments settle features that are constant or have few values. A feature that may be flagged has at most
    unique_percent distinct values per hundred samples, so a part of the samples, drawn by id, that shows more of them
    proves that it varies; LOOK times as many samples as that are looked at. Only the values of the features that this
    leaves are counted. It leaves those with few distinct values, which combine before their shuffle.
    """
    low = F.array_min(F.transform("c", lambda e: e["low"]))
    high = F.array_max(F.transform("c", lambda e: e["high"]))
    known = durable(moments.where(low < high).select("ord", (present("c") <= freq_ratio + 1).alias("few")))
    open_ = [r["ord"] for r in known.where("NOT few").select("ord").collect()]
    share = min(1.0, LOOK * unique_percent / 100)
    drawn = F.pmod(F.xxhash64(F.lit(3), "sample_id"), F.lit(1 << 20)) < round(share * (1 << 20))
    values = _cells_at(vectors.where(drawn), open_).where("value IS NOT NULL").distinct()
    seen = values.groupBy("ord").agg(F.count("*").alias("n"))
    many = seen.where(100.0 * F.col("n") / F.lit(float(total)) > unique_percent).select("ord")
    many = durable(known.where("few").select("ord").unionByName(many))
    settled = {r["ord"] for r in many.collect()}
    doubtful = [at for at in open_ if at not in settled]
    counted = near_zero_variance(_cells_at(vectors, doubtful), total, freq_ratio, unique_percent, "ord")
    return many.unionByName(counted.where("NOT near_zero").select("ord"))


def _cells_at(vectors: DataFrame, positions: list[int]) -> DataFrame:
    """(ord, value) of the entries at some positions only."""
    places = F.from_json(F.lit(json.dumps(positions)), "array<int>")
    taken = F.transform(places, lambda i: F.struct(i.alias("ord"), (F.get("x", i) + 0.0).alias("value")))
    return vectors.select(F.inline(taken))


def scaler(cells: DataFrame, kind: str = "sample", key: str = "feature") -> DataFrame:
    """Mean and scale per feature of the training cells.

    kind "sample": n-1 deviation. "population": n deviation, a constant feature has scale 1.
    "center": scale 1. "none": mean 0 and scale 1.
    """
    if kind == "sample":
        sd = F.stddev_samp("value")
    elif kind == "population":
        sd = F.when(F.stddev_pop("value") == 0, F.lit(1.0)).otherwise(F.stddev_pop("value"))
    elif kind in ("center", "none"):
        sd = F.lit(1.0)
    else:
        raise ValueError(f"unknown scaling: {kind}")
    mean = F.lit(0.0) if kind == "none" else F.avg("value")
    return cells.groupBy(key).agg(mean.alias("mean"), sd.alias("sd"))


def standardize(cells: DataFrame, scale: DataFrame, key: str = "feature") -> DataFrame:
    """(value - mean) / sd with a fitted scaler; a feature of zero deviation gives NULL."""
    shifted = F.try_divide(F.col("value") - F.col("mean"), F.col("sd"))
    return join_side(cells, scale, key).withColumn("value", shifted).drop("mean", "sd")
