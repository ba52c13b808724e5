"""Fits, reductions and mixtures against independent small computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import cohortgrid.operators.linear as linear
import cohortgrid.operators.reduce as reduce
from cohortgrid.matrix import Matrix
from cohortgrid.operators import contrasts, mixture
from cohortgrid.plans import studies
from cohortgrid.streaming.scoring import score_arriving, write_arriving


def frame(spark, x, **columns):
    rows = [(f"s{i}", [float(v) for v in x[i]], *[c[i] for c in columns.values()]) for i in range(len(x))]
    kinds = ["STRING" if isinstance(c[0], str) else "DOUBLE" if isinstance(c[0], float) else "INT" for c in columns.values()]
    schema = ", ".join(["sample_id STRING", "x ARRAY<DOUBLE>", *[f"{n} {k}" for n, k in zip(columns, kinds)]])
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    n, d = 150, 6
    x = rng.normal(size=(n, d))
    code = rng.choice(4, size=n, p=[0.55, 0.25, 0.15, 0.05])
    x[np.arange(n), code] += 1.0
    return x, code


def gradient(x, y, cost, w):
    z = np.hstack([x, np.ones((len(x), 1))])
    gap = np.maximum(0, 1 - y * (z @ w))
    return w - 2 * z.T @ (cost * y * gap)


def smooth_gradient(x, y, cost, w):
    return gradient(x, y, cost, w) - w


def test_binary_fit_is_stationary(spark, data):
    x, code = data
    label = (code == 0).astype(int)
    model = linear.fit_binary(frame(spark, x, label=label.tolist()), 6)
    y = np.where(label == 1, 1.0, -1.0)
    cost = np.where(label == 1, len(y) / (2 * label.sum()), len(y) / (2 * (1 - label).sum()))
    w = np.append(model.weights[0], model.bias[0])
    assert np.abs(gradient(x, y, cost, w)).max() < 1e-6
    scores = frame(spark, x).select("sample_id", model.score().alias("s")).collect()
    got = np.array([r["s"] for r in sorted(scores, key=lambda r: int(r["sample_id"][1:]))])
    assert np.allclose(got, x @ model.weights[0] + model.bias[0])
    assert got[label == 1].mean() > got[label == 0].mean()


def test_one_vs_rest_weighs_positives_only(spark, data):
    x, code = data
    classes = ["a", "b", "c", "d"]
    model = linear.fit_one_vs_rest(frame(spark, x, code=code.tolist()), 6, classes, classifier="ovr_LinearSVC_l2_c0.5")
    for k in range(4):
        y = np.where(code == k, 1.0, -1.0)
        cost = 0.5 * np.where(code == k, len(y) / (4 * (code == k).sum()), 1.0)
        assert np.abs(gradient(x, y, cost, np.append(model.weights[k], model.bias[k]))).max() < 1e-6


def test_row_weights_multiply_cost(spark, data):
    x, code = data
    label = (code == 0).astype(int)
    weight = 1.0 + np.arange(len(x)) % 3
    model = linear.fit_binary(frame(spark, x, label=label.tolist(), rw=weight.tolist()), 6, weight="rw")
    y = np.where(label == 1, 1.0, -1.0)
    cost = weight * np.where(label == 1, len(y) / (2 * label.sum()), len(y) / (2 * (1 - label).sum()))
    assert np.abs(gradient(x, y, cost, np.append(model.weights[0], model.bias[0]))).max() < 1e-6


def test_l1_fit_meets_subgradient_law(spark, data):
    x, code = data
    label = (code == 0).astype(int)
    model = linear.fit_binary(frame(spark, x, label=label.tolist()), 6, classifier="LinearSVC_l1_c0.02")
    y = np.where(label == 1, 1.0, -1.0)
    cost = 0.02 * np.where(label == 1, len(y) / (2 * label.sum()), len(y) / (2 * (1 - label).sum()))
    w = np.append(model.weights[0], model.bias[0])
    g = smooth_gradient(x, y, cost, w)
    assert (w == 0).any() and (w != 0).any()
    assert np.abs(g[w == 0]).max() <= 1 + 1e-6
    assert np.abs(g[w != 0] + np.sign(w[w != 0])).max() < 1e-6


@pytest.mark.parametrize("cost", ["0.02", "0.3"])
def test_l1_fit_without_curvature_agrees(spark, data, monkeypatch, cost):
    """Wide matrices: remembered curvature, same orthant rule, no limit on the width."""
    x, code = data
    df = frame(spark, x, label=(code == 0).astype(int).tolist())
    newton = linear.fit_binary(df, 6, classifier=f"LinearSVC_l1_c{cost}")
    monkeypatch.setattr(linear, "CURVATURE_BYTES", 0)
    memory = linear.fit_binary(df, 6, classifier=f"LinearSVC_l1_c{cost}", tolerance=1e-8)
    assert np.allclose(newton.weights, memory.weights, atol=1e-5)
    assert ((newton.weights == 0) == (memory.weights == 0)).all()


def test_gradient_only_path_agrees(spark, data, monkeypatch):
    x, code = data
    df = frame(spark, x, code=code.tolist())
    newton = linear.fit_one_vs_rest(df, 6, ["a", "b", "c", "d"])
    monkeypatch.setattr(linear, "CURVATURE_BYTES", 0)
    memory = linear.fit_one_vs_rest(df, 6, ["a", "b", "c", "d"], tolerance=1e-8)
    assert np.allclose(newton.weights, memory.weights, atol=1e-5) and memory.passes > newton.passes


def test_fit_ignores_row_order_and_partitions(spark, data):
    x, code = data
    df = frame(spark, x, label=(code == 0).astype(int).tolist())
    one = linear.fit_binary(df.coalesce(1), 6)
    many = linear.fit_binary(df.orderBy(F.hash("sample_id")).repartition(13), 6)
    assert np.allclose(one.weights, many.weights, atol=1e-9)


def test_fit_checks_input(spark, data):
    x, code = data
    df = frame(spark, x, label=(code == 0).astype(int).tolist(), code=code.tolist())
    with pytest.raises(ValueError, match="labels must be 0 and 1"):
        linear.fit_binary(df, 6, label="code")
    with pytest.raises(ValueError, match="without training samples"):
        linear.fit_one_vs_rest(df, 6, ["a", "b", "c", "d", "e"])
    with pytest.raises(ValueError, match="three or more"):
        linear.fit_one_vs_rest(df, 6, ["a", "b"])
    gappy = df.withColumn("x", F.transform("x", lambda v, i: F.when(i > 0, v)))
    with pytest.raises(Exception, match="must not have missing values"):
        linear.fit_binary(gappy, 6)


@pytest.mark.parametrize("text", ["LinearSVC_l3_c1", "SVC_l2_c1", "LinearSVC_l2", "LinearSVC_l2_cx", "LinearSVC_l2_c0", "ovo_LinearSVC_l2_c1"])
def test_bad_classifier_text(text):
    with pytest.raises(ValueError):
        linear.parse_classifier(text)


def test_classifier_text():
    assert linear.parse_classifier("ovr_LinearSVC_l1_c0.25") == linear.ClassifierSpec("l1", 0.25, True)


def test_arriving_samples_score_as_in_batch(spark, data, tmp_path):
    x, code = data
    df = frame(spark, x, code=code.tolist())
    model = linear.fit_one_vs_rest(df, 6, ["a", "b", "c", "d"])
    source = str(tmp_path / "in")
    df.drop("code").write.parquet(source)
    stream = spark.readStream.schema("sample_id STRING, x ARRAY<DOUBLE>").parquet(source)
    write_arriving(score_arriving(stream, model), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, score_arriving(df.drop("code"), model).collect()))
    assert got == want and len(got) == len(x)


# reduction


def reference_svd(x, k, ddof, scale=True):
    z = x - x.mean(axis=0)
    if scale:
        z = z / x.std(axis=0, ddof=ddof)
    v = np.linalg.svd(z, full_matrices=False)[2][:k].T
    return reduce.oriented(v)


@pytest.mark.parametrize("n,d,basis", [(40, 12, 1024), (12, 40, 1024), (60, 50, 4), (60, 50, 10)])
def test_reduction_of_any_shape(spark, monkeypatch, n, d, basis):
    """Bases narrower than the matrix need several rounds."""
    rng = np.random.default_rng(2)
    k = 3
    x = rng.normal(size=(n, d)) @ np.diag(np.linspace(1, 3, d)) + rng.normal(size=(n, 4)) @ rng.normal(size=(4, d)) * 3
    monkeypatch.setattr(reduce, "BASIS", basis)
    monkeypatch.setattr(reduce, "SPARE", 1)
    monkeypatch.setattr(reduce, "FAN", 2)
    model = reduce.fit_reduction(frame(spark, x).repartition(5), d, k)
    assert np.allclose(model.loadings, reference_svd(x, k, 1), atol=1e-6)
    got = {r["sample_id"]: r["z"] for r in frame(spark, x).select("sample_id", model.project().alias("z")).collect()}
    want = ((x - x.mean(axis=0)) / x.std(axis=0, ddof=1)) @ model.loadings
    assert np.allclose([got[f"s{i}"] for i in range(n)], want)


def test_unspanned_directions_project_to_zero_at_any_shape(spark):
    """Rank two: the third and fourth component are 0, tall or wide."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12, 2)) @ rng.normal(size=(2, 6))
    tall = reduce.fit_reduction(frame(spark, x), 6, 4)
    wide = reduce.fit_reduction(frame(spark, np.hstack([x, x, x])), 18, 4)
    for model in (tall, wide):
        assert (model.loadings[:, 2:] == 0).all() and (np.abs(model.loadings[:, :2]).max(axis=0) > 0.1).all()
    some = frame(spark, rng.normal(size=(3, 6)) * 5)
    z = np.array([r["z"] for r in some.select(tall.project().alias("z")).collect()])
    assert (z[:, 2:] == 0).all()
    flat = frame(spark, np.tile(rng.normal(size=(1, 6)), (5, 1)))
    nothing = reduce.fit_reduction(flat, 6, 2, "center", drop_near_zero=False)
    assert np.abs(nothing.loadings).max() <= 1


def test_reduction_refuses_missing_values(spark):
    x = np.random.default_rng(1).normal(size=(8, 4))
    x[3, 2] = np.nan
    with pytest.raises(ValueError, match="missing values"):
        reduce.fit_reduction(frame(spark, x), 4, 2)


def test_reduction_drops_flat_features_and_caps_k(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9, 5))
    x[:, 2] = 4.0
    model = reduce.fit_reduction(frame(spark, x), 5, 50)
    assert model.columns.tolist() == [0, 1, 3, 4] and model.k == 4
    wide = rng.normal(size=(4, 30))
    assert reduce.fit_reduction(frame(spark, wide), 30, 50).k == 4


def test_pca_kinds(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 4)) * [1, 2, 3, 4] + 5
    df = frame(spark, x)
    for kind, scale in (("center", False), ("none", False), ("population", True)):
        model = reduce.fit_reduction(df, 4, 2, kind, drop_near_zero=False)
        assert np.allclose(model.loadings, reference_svd(x, 2, 0, scale), atol=1e-8)
    assert model.names() == ["PC1", "PC2"]


def test_reduction_is_skipped_when_not_needed(spark):
    df = frame(spark, np.eye(3))
    same, _, width = reduce.reduce_if_wider(df, df, 3, 3)
    assert same is df and width == 3
    less, _, width = reduce.reduce_if_wider(df, df, 3, 2)
    assert width == 2 and len(less.first()["x"]) == 2
    assert reduce.reduce_by_spec(df, df, 3, "none")[0] is df
    with pytest.raises(ValueError):
        reduce.reduce_by_spec(df, df, 3, "svd2", "other")


@pytest.mark.parametrize("text,k", [("svd100", 100), (" SVD7 ", 7), ("none", 0), ("NA", 0), ("", 0), (None, 0)])
def test_reduction_text(text, k):
    assert reduce.parse_reduction(text) == k


def test_bad_reduction_text():
    with pytest.raises(ValueError):
        reduce.parse_reduction("pca5")


# moderated test


def test_moderated_test_against_plain_numbers(spark):
    rng = np.random.default_rng(8)
    classes, rows, annotation = ["a", "b", "c"], [], []
    for k, c in enumerate(classes):
        for i in range(4 + k):
            annotation.append((f"{c}{i}", c))
            for f in range(30):
                v = rng.normal(scale=0.2 + 0.1 * (f % 5)) + (2.0 if f == 3 and c == "a" else 0.0)
                rows.append((f"{c}{i}", f"f{f}", None if f == 7 and i == 0 else float(v)))
    cells = spark.createDataFrame(rows, "sample_id STRING, feature STRING, value DOUBLE")
    notes = spark.createDataFrame(annotation, "sample_id STRING, class STRING")
    profile = contrasts.profile_matrix(cells, notes, classes)
    prior = contrasts.variance_prior(profile)
    got = {(r["feature"], r["main"]): r for r in contrasts.moderated_test(
        contrasts.estimate(profile, contrasts.one_vs_rest(classes)), prior).collect()}

    from cohortgrid.functions.special import digamma_of, polygamma_of, t_upper_tail_of

    by = {}
    for s, f, v in rows:
        if v is not None:
            by.setdefault(f, {}).setdefault(s[0], []).append(v)
    s2, df = {}, {}
    for f, groups in by.items():
        df[f] = sum(map(len, groups.values())) - 3
        s2[f] = sum(np.var(v) * len(v) for v in groups.values()) / df[f]
    e = [math.log(s2[f]) - digamma_of(df[f] / 2) + math.log(df[f] / 2) for f in by]
    extra = np.var(e, ddof=1) - np.mean([polygamma_of(df[f] / 2)[0] for f in by])
    assert extra > 0
    assert polygamma_of(prior.df / 2)[0] == pytest.approx(extra, rel=1e-9)
    assert prior.s2 == pytest.approx(math.exp(np.mean(e) + digamma_of(prior.df / 2) - math.log(prior.df / 2)))
    for f, groups in by.items():
        post = (prior.df * prior.s2 + df[f] * s2[f]) / (prior.df + df[f])
        means = {c: np.mean(v) for c, v in groups.items()}
        logfc = means["a"] - means["b"] - means["c"]
        se = math.sqrt(post * sum(1 / len(v) for v in groups.values()))
        total = min(prior.df + df[f], sum(df.values()))
        p = t_upper_tail_of(np.array([(abs(logfc) - 1) / se, (abs(logfc) + 1) / se]), total).sum()
        row = got[(f, "a")]
        assert row["logfc"] == pytest.approx(logfc) and row["p"] == pytest.approx(p, rel=1e-9)
        assert row["t"] == pytest.approx(math.copysign(max((abs(logfc) - 1) / se, 0), logfc), abs=1e-12)
    assert got[("f3", "a")]["t"] > 0


# mixture


def make_mixture(rng, markers=40, tissues=4, samples=6):
    a = rng.uniform(0, 10, size=(markers, tissues))
    truth = rng.dirichlet(np.ones(tissues), size=samples)
    truth[0] = np.eye(tissues)[0]
    b = truth @ a.T + rng.normal(scale=0.3, size=(samples, markers))
    return a, truth, b


def mixture_frames(spark, a, b, skip=()):
    profiles = spark.createDataFrame(
        [(f"m{i}", row.tolist()) for i, row in enumerate(a)] + [("unused", [9.0] * a.shape[1])], "feature STRING, a ARRAY<DOUBLE>"
    )
    cells = [(f"s{s}", f"m{i}", float(b[s, i])) for s in range(len(b)) for i in range(len(a)) if (s, i) not in skip]
    return profiles, spark.createDataFrame(cells + [("s0", "extra", 1.0)], "sample_id STRING, feature STRING, value DOUBLE")


def brute(gram, c):
    from itertools import combinations

    best = (np.inf, None)
    for size in range(1, len(c) + 1):
        for s in map(list, combinations(range(len(c)), size)):
            system = np.ones((size + 1, size + 1))
            system[:size, :size], system[size, size] = gram[np.ix_(s, s)], 0
            x = np.zeros(len(c))
            x[s] = np.linalg.solve(system, np.append(c[s], 1))[:size]
            if x.min() >= -1e-12:
                best = min(best, (0.5 * x @ gram @ x - c @ x, x.tolist()))
    return np.array(best[1])


def test_fractions_against_brute_force(spark):
    rng = np.random.default_rng(11)
    a, truth, b = make_mixture(rng)
    skip = {(2, 0), (2, 5), (4, 7)}
    profiles, cells = mixture_frames(spark, a, b, skip)
    tissues = ["t10", "t2", "t1", "t3"]
    stats = mixture.mixture_statistics(cells, profiles, tissues)
    assert {r["sample_id"]: r["n"] for r in stats.collect()} == {f"s{s}": 40 - sum(p[0] == s for p in skip) for s in range(6)}
    table = mixture.fraction_table(mixture.mixture_fractions(stats, tissues), tissues)
    assert table.columns == ["sample_id", "t1", "t10", "t2", "t3"]
    for row in table.collect():
        s = int(row["sample_id"][1:])
        kept = [i for i in range(40) if (s, i) not in skip]
        want = brute(a[kept].T @ a[kept], a[kept].T @ b[s, kept])
        assert np.allclose([row[t] for t in tissues], want, atol=1e-8)


@pytest.mark.parametrize("run_bytes", [mixture.RUN_BYTES, 300])
def test_no_sample_is_lost(spark, monkeypatch, run_bytes):
    monkeypatch.setattr(mixture, "RUN_BYTES", run_bytes)
    rng = np.random.default_rng(14)
    a, _, b = make_mixture(rng, markers=20)
    profiles, _ = mixture_frames(spark, a, b)
    names = ["other", *[f"m{i}" for i in reversed(range(20))]]
    rows = [(f"s{s}", [1.0, *b[s, ::-1].tolist()]) for s in range(6)] + [("blank", [1.0] + [None] * 20)]
    matrix = Matrix.from_vectors(spark.createDataFrame(rows, "sample_id STRING, x ARRAY<DOUBLE>"), names)
    for data in (matrix, matrix.cells()):
        got = {r["sample_id"]: r for r in mixture.mixture_statistics(data, profiles, list("abcd")).collect()}
        assert {k: r["n"] for k, r in got.items()} == {**{f"s{s}": 20 for s in range(6)}, "blank": 0}
        for s in range(6):
            assert np.allclose(got[f"s{s}"]["ab"], a.T @ b[s]) and np.isclose(got[f"s{s}"]["bb"], b[s] @ b[s])
            assert np.allclose(got[f"s{s}"]["aa"], (a.T @ a)[np.triu_indices(4)])
        table = {r["sample_id"]: r[1:] for r in mixture.deconvolve(data, profiles, list("abcd")).collect()}
        assert len(table) == 7 and table["blank"] == (None,) * 4
    twice = Matrix.from_vectors(matrix.vectors.unionByName(matrix.vectors), names)
    with pytest.raises(ValueError, match="duplicate sample_id"):
        studies.deconvolution(twice, profiles, list("abcd"))
    with pytest.raises(Exception, match="repeated cell"):
        mixture.deconvolve(matrix.cells().unionByName(matrix.cells()), profiles, list("abcd")).collect()


def test_scoring_refuses_missing_values_and_leaves_settings(spark):
    before = dict(spark.conf.getAll)
    model = linear.LinearModel(np.ones((1, 2)), np.zeros(1), ("1",))
    rows = spark.createDataFrame([("s", [1.0, 2.0]), ("t", [None, 9.0])], "sample_id STRING, x ARRAY<DOUBLE>")
    assert rows.where("sample_id = 's'").select(model.score("x").alias("v")).first()["v"] == 3.0
    with pytest.raises(Exception, match="to score must not have missing values"):
        rows.select(model.score("x")).collect()
    wide = linear.LinearModel(np.ones((3, 5_000_000)), np.zeros(3), ("a", "b", "c"))
    wide.scores("x")
    assert dict(spark.conf.getAll) == before


def test_posterior_is_seeded_and_near_the_truth(spark):
    rng = np.random.default_rng(12)
    a, truth, b = make_mixture(rng, markers=80)
    profiles, cells = mixture_frames(spark, a, b)
    tissues = ["a", "b", "c", "d"]
    stats = mixture.mixture_statistics(cells, profiles, tissues)
    first = {r["sample_id"]: r["fractions"] for r in mixture.mixture_fractions(stats.coalesce(1), tissues, "posterior_mean", 800).collect()}
    again = {r["sample_id"]: r["fractions"] for r in mixture.mixture_fractions(stats.repartition(4), tissues, "posterior_mean", 800).collect()}
    for s, x in first.items():
        assert x == pytest.approx(again[s], abs=1e-6)
        assert sum(x) == pytest.approx(1) and min(x) >= 0
        assert np.allclose(x, truth[int(s[1:])], atol=0.05)


def test_batched_fits_are_optimal():
    """Slopes are equal on the support and no smaller off it; supports of many sizes, also where aa is singular."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(300):
        a = rng.normal(size=(3 if i % 7 == 0 else 9, 6)) + rng.normal() * (i % 3)
        x = rng.dirichlet(np.full(6, 0.3))
        b = a @ x + rng.normal(size=len(a)) * rng.choice([0.01, 1.0, 5.0])
        rows.append((a.T @ a, a.T @ b))
    aa, ab = (np.array(v) for v in zip(*rows))
    x = mixture.constrained_fits(aa, ab)
    assert np.allclose(x.sum(axis=1), 1) and (x >= 0).all()
    assert len({tuple(p) for p in x > 0}) > 10
    slope = np.einsum("ijk,ik->ij", aa, x) - ab
    scale = np.abs(aa).max(axis=(1, 2)) + np.abs(ab).max(axis=1)
    level = np.where(x > 1e-9, slope, np.inf).min(axis=1)
    assert (slope - level[:, None] > -1e-7 * scale[:, None]).all()
    assert (np.where(x > 1e-9, slope - level[:, None], 0) < 1e-7 * scale[:, None]).all()


def test_draws_agree_with_quadrature():
    rng = np.random.default_rng(3)
    for n in (4, 12, 200):
        a = rng.normal(size=(n, 2))
        b = a @ np.array([0.2, 0.8]) + rng.normal(size=n)
        args = (a.T @ a)[None], (a.T @ b)[None], np.array([b @ b]), np.array([n])
        assert np.abs(mixture.two_part_mean(*args) - mixture.drawn_mean(*args, [1], 40000)).max() < 0.01


def test_posterior_mean_matches_integration():
    """Two tissues: the posterior of one fraction can be integrated on a grid."""
    rng = np.random.default_rng(13)
    a = rng.uniform(0, 1, size=(15, 2))
    b = a @ [0.2, 0.8] + rng.normal(scale=0.3, size=15)
    grid = (np.arange(20000) + 0.5) / 20000
    errors = ((b[:, None] - a @ np.array([grid, 1 - grid])) ** 2).sum(axis=0)
    density = errors ** (-15 / 2)
    want = (grid * density).sum() / density.sum()
    got = mixture.posterior_mean((a.T @ a)[None], (a.T @ b)[None], np.array([b @ b]), np.array([15]), [1], 40000)
    assert got[0, 0] == pytest.approx(want, abs=0.01)


def test_profiles_need_every_tissue(spark):
    rows = [("m1", "a", 1.0), ("m1", "b", 2.0), ("m2", "a", 3.0)]
    long = spark.createDataFrame(rows, "feature STRING, tissue STRING, value DOUBLE")
    assert [(r["feature"], r["a"]) for r in mixture.profile_vectors(long, ["a", "b"]).collect()] == [("m1", [1.0, 2.0])]
    with pytest.raises(ValueError, match="unknown mode"):
        mixture.mixture_fractions(long, ["a"], "other")


def test_matrix_from_wide(spark):
    wide = spark.createDataFrame([("s", "1.5", "bad"), ("t", "NA", "2")], "id STRING, `a.b` STRING, c STRING")
    matrix = Matrix.from_wide(wide, "id")
    assert matrix.names() == ["a.b", "c"]
    assert {r["sample_id"]: r["x"] for r in matrix.vectors.collect()} == {"s": [1.5, None], "t": [None, 2.0]}
