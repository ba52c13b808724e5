"""Fractions of known profiles in each sample: x >= 0, sum x = 1, A x close to b.

The heavy part is two products per batch of samples. What is solved per sample is as small as the number of
tissues, and runs inside tasks over batches of samples.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from cohortgrid.cluster import durable, task_count
from cohortgrid.fixed import MIXTURE_DRAWS
from cohortgrid.matrix import Matrix
from cohortgrid.operators.partials import dense, list_column

RUN_BYTES = 32 << 20


def profile_vectors(profiles: DataFrame, tissues: list[str]) -> DataFrame:
    """Long profiles(feature, tissue, value) -> (feature, a) over the tissues; features that lack any
    tissue are dropped."""
    by_tissue = [F.max(F.when(F.col("tissue") == t, F.col("value"))) for t in tissues]
    vectors = profiles.groupBy("feature").agg(F.array(*by_tissue).alias("a"))
    return vectors.where(~F.exists("a", lambda v: v.isNull()))


def _vector_sum(column):
    return vector_to_array(Summarizer.sum(array_to_vector(column)))


def mixture_statistics(data: Matrix | DataFrame, profiles: DataFrame, tissues: list[str]) -> DataFrame:
    """(sample_id, n, bb, ab, aa): known markers, b'b, A'b and the packed upper triangle of A'A over them.

    Every sample of the matrix, or of the cells, has a row; n is 0 if it has none of the markers. Profile rows
    of features that the data lacks have no effect.

    Vectors are cut to the markers and meet the profiles inside a task, so no cell is shuffled. Profiles go to
    the tasks in runs of at most RUN_BYTES; the sums of several runs are added per sample.
    """
    profiles = durable(profiles.select("feature", "a"))
    if not isinstance(data, Matrix):
        data = Matrix.from_cells(data, sorted(r["feature"] for r in profiles.select("feature").collect()))
    used = data.positions_of(profiles)
    row_bytes = 8 * len(tissues) + 4
    runs = max(1, math.ceil(used.count() * row_bytes / RUN_BYTES))
    parts = [_run_sums(data.vectors, used.where(F.pmod("ord", F.lit(runs)) == i), len(tissues)) for i in range(runs)]
    if runs == 1:
        return parts[0]
    return (
        reduce(DataFrame.unionByName, map(durable, parts))
        .groupBy("sample_id")
        .agg(F.sum("n").alias("n"), F.sum("bb").alias("bb"), _vector_sum("ab").alias("ab"), _vector_sum("aa").alias("aa"))
    )


def _run_sums(vectors: DataFrame, used: DataFrame, size: int) -> DataFrame:
    """The statistics over one run of markers. Samples that know the same markers share one A'A of a batch."""
    rows = used.select("ord", "a").toArrow()
    order = np.argsort(rows.column("ord").to_numpy())
    a = dense(rows.column("a"), size)[order]
    take = rows.column("ord").to_numpy()[order].tolist()
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = dense(batch.column("b"), len(a))
            known = ~np.isnan(given)
            b = np.where(known, given, 0.0)
            patterns, of = np.unique(np.packbits(known, axis=1), axis=0, return_inverse=True)
            aa = np.empty((batch.num_rows, len(upper[0])))
            for i in range(len(patterns)):
                same = of.ravel() == i
                mine = a[known[np.argmax(same)]]
                aa[same] = (mine.T @ mine)[upper]
            yield pa.record_batch(
                [
                    batch.column("sample_id"),
                    pa.array(known.sum(axis=1)),
                    pa.array(np.einsum("ij,ij->i", b, b)),
                    list_column(b @ a),
                    list_column(aa),
                ],
                names=["sample_id", "n", "bb", "ab", "aa"],
            )

    places = F.from_json(F.lit(json.dumps(take)), "array<int>")
    cut = vectors.select("sample_id", F.transform(places, lambda i: F.get("x", i)).alias("b"))
    return cut.mapInArrow(run, "sample_id STRING, n LONG, bb DOUBLE, ab ARRAY<DOUBLE>, aa ARRAY<DOUBLE>")


def _unpacked(packed: np.ndarray, size: int) -> np.ndarray:
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = packed
    return full + np.triu(full, 1).T


def constrained_fits(aa: np.ndarray, ab: np.ndarray) -> np.ndarray:
    """For each row, minimise x'(aa)x/2 - (ab)'x over x >= 0, sum x = 1, by an active-set walk on the support of x.

    All rows walk side by side; those with one support are solved in one call.
    """
    count, size = ab.shape
    x = np.zeros((count, size))
    support = np.zeros((count, size), bool)
    first = np.argmin(0.5 * np.einsum("ijj->ij", aa) - ab, axis=1)
    x[np.arange(count), first] = 1.0
    support[np.arange(count), first] = True
    tiny = 1e-12 * np.maximum(1.0, np.maximum(np.abs(aa).max(axis=(1, 2)), np.abs(ab).max(axis=1)))
    walking = np.arange(count)
    for _ in range(200 * size + 200):
        if not len(walking):
            break
        patterns, of = np.unique(support[walking], axis=0, return_inverse=True)
        going = []
        for p, pattern in enumerate(patterns):
            rows, inside = walking[of.ravel() == p], np.flatnonzero(pattern)
            target = _on_support(aa[np.ix_(rows, inside, inside)], ab[np.ix_(rows, inside)])
            falling = target <= 0
            blocked = falling.any(axis=1)
            if blocked.any():  # go as far as the first weight that reaches 0, and take it out
                some, fall, aim = rows[blocked], falling[blocked], target[blocked]
                here = x[np.ix_(some, inside)]
                share = np.where(fall, here / np.where(fall, here - aim, 1.0), np.inf)
                out = share.argmin(axis=1)
                step = np.minimum(1.0, share.min(axis=1))[:, None]
                x[np.ix_(some, inside)] = np.maximum(here + step * (aim - here), 0.0)
                x[some, inside[out]] = 0.0
                support[some, inside[out]] = False
                going.append(some)
            if not blocked.all():  # at the optimum of its support: enter the weight that gains most, if one does
                some = rows[~blocked]
                x[some] = 0.0
                x[np.ix_(some, inside)] = target[~blocked]
                slope = np.einsum("ijk,ik->ij", aa[some], x[some]) - ab[some]
                gain = slope - slope[:, inside].mean(axis=1, keepdims=True)
                gain[:, inside] = 0.0
                enter = gain.argmin(axis=1)
                more = gain[np.arange(len(some)), enter] < -tiny[some]
                support[some[more], enter[more]] = True
                going.append(some[more])
        walking = np.sort(np.concatenate(going))
    return x / x.sum(axis=1, keepdims=True)


def _on_support(aa: np.ndarray, ab: np.ndarray) -> np.ndarray:
    """The minimum over sum x = 1 of each row, signs free."""
    count, n = ab.shape
    system = np.ones((count, n + 1, n + 1))
    system[:, :n, :n] = aa
    system[:, n, n] = 0.0
    right = np.concatenate([ab, np.ones((count, 1))], axis=1)[:, :, None]
    try:
        solved = np.linalg.solve(system, right)
    except np.linalg.LinAlgError:
        solved = np.linalg.pinv(system) @ right
    return solved[:, :n, 0]


def two_part_mean(aa: np.ndarray, ab: np.ndarray, bb: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The posterior mean for two parts, by quadrature instead of draws.

    With the error variance integrated out, the density of the first fraction t is the squared error, a quadratic in t,
    to the power -n/2. It is integrated where it is above e^-60 of its top.
    """
    curve = aa[:, 0, 0] - 2 * aa[:, 0, 1] + aa[:, 1, 1]
    tilt = ab[:, 0] - ab[:, 1] + aa[:, 1, 1] - aa[:, 0, 1]
    rest = bb - 2 * ab[:, 1] + aa[:, 1, 1]
    curve = np.maximum(curve, 1e-300)
    mid = tilt / curve
    least = np.maximum(rest - tilt * mid, 1e-12 * np.maximum(bb, 1e-300))
    top = np.clip(mid, 0.0, 1.0)
    at_top = least + curve * (top - mid) ** 2
    reach = np.sqrt(np.maximum(at_top * np.exp(np.minimum(120.0 / n, 700.0)) - least, 0.0) / curve)
    low, high = np.maximum(0.0, mid - reach), np.minimum(1.0, mid + reach)
    nodes, weights = np.polynomial.legendre.leggauss(400)
    t = low[:, None] + (high - low)[:, None] * (nodes + 1) / 2
    log = -n[:, None] / 2 * (np.log(least[:, None] + curve[:, None] * (t - mid[:, None]) ** 2) - np.log(at_top)[:, None])
    mass = np.exp(log) * weights
    mean = (mass * t).sum(axis=1) / mass.sum(axis=1)
    return np.stack([mean, 1 - mean], axis=1)


def posterior_mean(
    aa: np.ndarray, ab: np.ndarray, bb: np.ndarray, n: np.ndarray, seeds: list[int], draws: int
) -> np.ndarray:
    """Mean of x, uniform a priori on the simplex, normal errors of unknown variance: integrated for two parts, else
    drawn."""
    return two_part_mean(aa, ab, bb, n) if ab.shape[1] == 2 else drawn_mean(aa, ab, bb, n, seeds, draws)


def drawn_mean(
    aa: np.ndarray, ab: np.ndarray, bb: np.ndarray, n: np.ndarray, seeds: list[int], draws: int
) -> np.ndarray:
    """The posterior mean by draws.

    All samples of the batch walk side by side. A step redraws the error variance, takes a random direction
    within sum x = 1, and slice-samples the normal density along it, cut to x >= 0. Each sample has its own
    random stream, so a draw does not depend on which samples share its batch.
    """
    count, size = ab.shape
    x = 0.98 * constrained_fits(aa, ab) + 0.02 / size
    if size == 1:
        return x
    streams = [np.random.default_rng(s) for s in seeds]
    flat = np.eye(size) - 1.0 / size
    spread = np.empty_like(aa)
    for i in range(count):
        values, vectors = np.linalg.eigh(flat @ aa[i] @ flat)
        keep = values > 1e-9 * max(values[-1], 1e-300)
        spread[i] = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T
    total = np.zeros_like(x)
    chunk = 200
    burn = draws // 5
    done = 0
    while done < draws + burn:
        todo = min(chunk, draws + burn - done)
        normals = np.stack([r.standard_normal((todo, size)) for r in streams], axis=1)
        uniforms = np.stack([r.random((todo, 2)) for r in streams], axis=1)
        gammas = np.stack([r.standard_gamma(n[i] / 2.0, todo) for i, r in enumerate(streams)], axis=1)
        for s in range(todo):
            fit = np.einsum("ij,ijk,ik->i", x, aa, x) - 2 * np.einsum("ij,ij->i", x, ab) + bb
            variance = np.maximum(fit, 1e-300) / (2 * gammas[s])
            d = np.einsum("ijk,ik->ij", spread, normals[s])
            d -= d.mean(axis=1, keepdims=True)
            slope = np.einsum("ij,ij->i", d, np.einsum("ijk,ik->ij", aa, x) - ab)
            curve = np.maximum(np.einsum("ij,ijk,ik->i", d, aa, d), 1e-300)
            mid, width2 = -slope / curve, variance / curve
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = -x / d
            low = np.where(d > 0, reach, -np.inf).max(axis=1)
            high = np.where(d < 0, reach, np.inf).min(axis=1)
            radius = np.sqrt(mid * mid - 2 * width2 * np.log(np.maximum(uniforms[s, :, 0], 1e-300)))
            low, high = np.maximum(low, mid - radius), np.minimum(high, mid + radius)
            t = low + (high - low) * uniforms[s, :, 1]
            x = np.maximum(x + np.where(np.isfinite(t), t, 0.0)[:, None] * d, 0.0)
            x /= x.sum(axis=1, keepdims=True)
            if done + s >= burn:
                total += x
        done += todo
    return total / draws


def mixture_fractions(
    statistics: DataFrame, tissues: list[str], mode: str = "constrained_ls", draws: int = MIXTURE_DRAWS
) -> DataFrame:
    """(sample_id, fractions ARRAY) from the statistics: the constrained least-squares point, or the mean
    of seeded posterior draws. A sample without known markers has NULL fractions."""
    if mode not in ("constrained_ls", "posterior_mean"):
        raise ValueError(f"unknown mode: {mode}")
    size = len(tissues)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                told = part[part["n"] > 0]
                x = []
                if len(told):
                    aa = np.array([_unpacked(v, size) for v in told["aa"]])
                    ab = np.array(told["ab"].to_list())
                    if mode == "constrained_ls":
                        x = constrained_fits(aa, ab)
                    else:
                        seeds = [zlib.crc32(s.encode()) for s in told["sample_id"]]
                        x = posterior_mean(aa, ab, told["bb"].to_numpy(), told["n"].to_numpy(), seeds, draws)
                blank = part.loc[part["n"] == 0, "sample_id"].tolist()
                yield pd.DataFrame(
                    {
                        "sample_id": [*told["sample_id"], *blank],
                        "fractions": [*[v.tolist() for v in x], *[None] * len(blank)],
                    }
                )

    # the rows are few bytes but much work: spread them by number, not by size
    spread = statistics.repartition(task_count(statistics.sparkSession), "sample_id")
    return spread.select("sample_id", "n", "bb", "ab", "aa").mapInPandas(
        solve, "sample_id STRING, fractions ARRAY<DOUBLE>"
    )


def fraction_table(fractions: DataFrame, tissues: list[str]) -> DataFrame:
    """One column per tissue, in sorted order, after sample_id."""
    columns = [F.element_at("fractions", tissues.index(t) + 1).alias(t) for t in sorted(tissues)]
    return fractions.select("sample_id", *columns)


def deconvolve(
    data: Matrix | DataFrame,
    profiles: DataFrame,
    tissues: list[str],
    mode: str = "constrained_ls",
    draws: int = MIXTURE_DRAWS,
) -> DataFrame:
    """Tissue fractions of every sample: statistics, solve, wide table."""
    statistics = mixture_statistics(data, profiles, tissues)
    return fraction_table(mixture_fractions(statistics, tissues, mode, draws), tissues)
