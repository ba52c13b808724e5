"""One-pass statistics against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import cohortgrid.operators.moments as moments
from cohortgrid.matrix import Matrix
from cohortgrid.operators import quality
from cohortgrid.operators.moments import matrix_moments, vector_moments


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(loc=1e6, scale=0.5, size=(60, 37))  # far from 0: sums of squares would lose all digits
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5] = np.nan
    x[:, 6] = 3.0
    names = [None, "a", "b", "c"]
    return x, [names[i] for i in rng.choice(4, size=60, p=[0.1, 0.6, 0.25, 0.05])]


def frame(spark, x, group):
    rows = [(f"s{i}", [None if np.isnan(v) else float(v) for v in x[i]], group[i]) for i in range(len(x))]
    return spark.createDataFrame(rows, "sample_id STRING, x ARRAY<DOUBLE>, g STRING")


@pytest.mark.parametrize("parts,state", [(1, 256 << 20), (7, 256 << 20), (4, 1), (60, 256 << 20)])
def test_moments_equal_numpy(spark, data, monkeypatch, parts, state):
    x, group = data
    monkeypatch.setattr(moments, "STATE_BYTES", state)
    got = {r["ord"]: r["c"] for r in vector_moments(frame(spark, x, group).repartition(parts), 37, "g", cutoff=1e6).collect()}
    assert sorted(got) == list(range(37))
    for at, entries in got.items():
        assert [e["class"] for e in entries] == sorted({g for g in group if g}) + [None]
        for e in entries:
            v = x[[g == e["class"] for g in group], at]
            v = v[~np.isnan(v)]
            assert e["n"] == len(v) and e["over"] == (v > 1e6).sum()
            if not len(v):
                assert e["mean"] is None and e["low"] is None and e["ss"] == 0
                continue
            assert e["low"] == v.min() and e["high"] == v.max()
            assert np.isclose(e["mean"], v.mean(), rtol=1e-14) and np.isclose(e["total"], v.sum(), rtol=1e-13)
            assert np.isclose(e["ss"], v.var() * len(v), rtol=1e-6, atol=1e-9)


def test_no_row_per_cell_and_one_shuffle(spark, data):
    x, group = data
    plan = vector_moments(frame(spark, x, group), 37, "g")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_moments_of_nothing(spark, data):
    x, group = data
    assert vector_moments(frame(spark, x, group).limit(0), 37).count() == 0


def test_vector_forms_agree_with_cells(spark, data):
    x, group = data
    x = np.vstack([x, np.full((1, 37), np.nan)])
    matrix = Matrix.from_vectors(frame(spark, x, [*group, "a"]), [f"f{i:02d}" for i in range(37)])
    n = len(x)
    flags = quality.feature_missingness(matrix_moments(matrix), n)
    by_cell = quality.missingness(matrix.cells(), n)
    assert sorted(map(tuple, matrix.named(flags).collect())) == sorted(map(tuple, by_cell.collect()))
    left = quality.drop_features(matrix, flags)
    assert left.names() == sorted(r["feature"] for r in by_cell.where("kept").collect())
    assert sorted(map(tuple, quality.sample_missingness(matrix).collect())) == sorted(
        map(tuple, quality.missingness(matrix.cells(), 37, "sample_id").collect())
    )
    full = quality.drop_empty_samples(matrix)
    assert full.vectors.count() == n - 1
    for kind in ("sample", "population", "center", "none"):
        fitted = quality.feature_scaler(matrix_moments(matrix), kind)
        one = {(r[0], r[1]): r[2] for r in quality.standardize_matrix(matrix, fitted).cells().collect()}
        two = {(r["sample_id"], r["feature"]): r["value"] for r in quality.standardize(matrix.cells(), quality.scaler(matrix.cells(), kind)).collect()}
        assert one.keys() == two.keys()
        for key, v in two.items():
            assert (v is None) == (one[key] is None) and (v is None or np.isclose(v, one[key], rtol=1e-6, atol=1e-8))


def test_unknown_scaling(spark, data):
    with pytest.raises(ValueError):
        quality.feature_scaler(vector_moments(frame(spark, *data), 37), "other")


@pytest.mark.parametrize("ratio,percent", [(3.0, 10.0), (19.0, 10.0), (3.0, 60.0), (899.0, 1.0)])
def test_varying_features_agree_with_counting(spark, ratio, percent):
    rng = np.random.default_rng(7)
    n = 400
    columns = [rng.normal(size=n), np.zeros(n), np.full(n, np.nan), np.r_[1.0, np.zeros(n - 1)], rng.integers(0, 3, n) * 1.0]
    columns += [np.where(rng.random(n) < p, rng.normal(size=n), 0.0) for p in (0.02, 0.05, 0.1, 0.3, 0.7)]
    columns += [np.where(rng.random(n) < p, rng.integers(0, 30, n), -0.0) for p in (0.1, 0.4, 0.9)]
    columns += [np.where(np.arange(n) < 3, np.arange(n), np.nan), np.where(rng.random(n) < 0.5, np.nan, rng.integers(0, 2, n) * 1.0)]
    x = np.array(columns).T
    df = frame(spark, x, ["a"] * n)
    cells = df.select(F.posexplode("x").alias("ord", "value"))
    want = {r["ord"] for r in quality.near_zero_variance(cells, n, ratio, percent, "ord").where("NOT near_zero").collect()}
    got = [r["ord"] for r in quality.varying_features(df, vector_moments(df, x.shape[1]), n, ratio, percent).collect()]
    assert sorted(got) == sorted(want)


def test_fill_missing_puts_means_of_the_training_samples(spark, data):
    x, group = data
    vectors = frame(spark, x, group)
    matrix = Matrix(vectors.select("sample_id", "x"), 37, tuple(f"f{i}" for i in range(37)))
    train = vectors.where("g = 'a'").select("sample_id")
    filled = quality.fill_missing(matrix, quality.feature_scaler(matrix_moments(matrix, train), "center"))
    mine = np.array([v for _, v in sorted((int(r["sample_id"][1:]), r["x"]) for r in filled.vectors.collect())])
    own = x[[g == "a" for g in group]]
    known = ~np.isnan(own)
    means = np.where(known, own, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
    assert np.allclose(mine, np.where(np.isnan(x), means, x), rtol=1e-12, atol=0) and means[5] == 0.0
