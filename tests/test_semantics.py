"""Small hand-made cases for the rules that differ between operators."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window, functions as F

from cohortgrid.cluster import join_side, require_present
from cohortgrid.functions.scores import probabilities, share_of_sum, top_label, top_ratio
from cohortgrid.matrix import Matrix, number, unfolded
from cohortgrid.operators import align, cohort, contrasts, paired, quality
from cohortgrid.plans import studies


def cells_of(spark, rows):
    return spark.createDataFrame(rows, "sample_id STRING, feature STRING, value DOUBLE")


@pytest.fixture(scope="module")
def samples(spark):
    rows = [("a", "x", "train"), ("b", "y", "Test"), ("c", "x", None), ("d", "z", "test"), ("e", None, "train")]
    return spark.createDataFrame(rows, "sample_id STRING, class STRING, part STRING")


def ids(df):
    return sorted(r["sample_id"] for r in df.collect())


# splits and labels


def test_exact_split_leaves_out_missing(samples):
    train, test = cohort.split_exact(samples, "part:test")
    assert ids(train) == ["a", "b", "e"] and ids(test) == ["d"]


def test_any_case_split_trains_on_missing(samples):
    train, test = cohort.split_any_case(samples, "part:TEST")
    assert ids(train) == ["a", "c", "e"] and ids(test) == ["b", "d"]


def test_empty_side_raises(samples):
    with pytest.raises(ValueError, match="leaves no test"):
        cohort.require_both_sides(samples, "part:nothing")
    with pytest.raises(ValueError, match="leaves no training"):
        cohort.require_both_sides(samples.where("sample_id = 'd'"), "part:test")
    with pytest.raises(ValueError, match="leaves no test"):
        cohort.require_both_sides(samples, "part:TEST", any_case=False)


@pytest.mark.parametrize("spec", ["part", "part:", ":test", "part:test:more", ""])
def test_strict_split_spec(spec):
    with pytest.raises(ValueError):
        cohort.parse_split(spec, strict=True)


def test_loose_split_spec_ignores_more_parts():
    assert cohort.parse_split("part:test:more") == ("part", "test")


def test_unknown_split_column(samples):
    with pytest.raises(ValueError, match="not in the annotation"):
        cohort.split_exact(samples, "nope:test")


def test_class_counts_show_zero(samples):
    counts = {r["class"]: (r["n_train"], r["n_test"]) for r in cohort.split_counts(samples, "part:test", "class").collect()}
    assert counts["z"] == (0, 1) and counts["x"] == (1, 0)


def test_without_class_drops_missing(samples):
    assert ids(cohort.without_class(samples, "class", "x")) == ["b", "d"]


def test_status_codes(spark):
    df = spark.createDataFrame([("normal",), ("cancer",), ("other",), (None,)], "cancer_status STRING")
    assert [r[0] for r in df.select(cohort.status_code()).collect()] == [0, 1, None, None]


def test_class_codes_follow_code_points(spark):
    df = spark.createDataFrame([("b",), ("B",), ("a",), ("_",)], "k STRING")
    classes = cohort.sorted_classes(df, "k")
    assert classes == ["B", "_", "a", "b"]
    assert [r[0] for r in df.select(cohort.class_code("k", classes)).collect()] == [3, 0, 2, 1]
    with pytest.raises(PySparkException, match="not in the class list"):
        df.select(cohort.class_code("k", ["a"])).collect()


def test_balanced_weights(spark):
    df = spark.createDataFrame([("p",)] * 3 + [("q",)], "k STRING")
    weights = {r["class"]: r["weight"] for r in cohort.balanced_weights(df, "k").collect()}
    assert weights == {"p": pytest.approx(4 / 6), "q": 2.0}


# matrix forms


def test_vectors_from_cells_fill_and_sort(spark):
    cells = cells_of(spark, [("s", "b", 2.0), ("s", "a", 1.0), ("t", "b", None), ("t", "c", 5.0)])
    matrix = Matrix.from_cells(cells)
    assert matrix.names() == ["a", "b", "c"]
    assert {r["sample_id"]: r["x"] for r in matrix.vectors.collect()} == {"s": [1.0, 2.0, None], "t": [None, None, 5.0]}


def test_sample_without_listed_features_stays(spark):
    cells = cells_of(spark, [("s", "a", 1.0), ("t", "q", 2.0), ("t", "r", 3.0), ("u", "q", None)])
    matrix = Matrix.from_cells(cells, ["a", "b"])
    assert {r["sample_id"]: r["x"] for r in matrix.vectors.collect()} == {"s": [1.0, None], "t": [None] * 2, "u": [None] * 2}


def test_repeated_cell_raises(spark):
    cells = cells_of(spark, [("s", "a", 1.0), ("s", "a", 2.0)])
    with pytest.raises(PySparkException, match="repeated cell of sample s"):
        Matrix.from_cells(cells).vectors.collect()


def test_project_reorders_and_checks(spark):
    matrix = Matrix.from_cells(cells_of(spark, [("s", "a", 1.0), ("s", "b", 2.0), ("s", "c", 3.0)]))
    assert matrix.project(["c", "a"]).vectors.first()["x"] == [3.0, 1.0]
    with pytest.raises(ValueError, match="2 selected features"):
        matrix.project(["a", "q", "r"])


def test_round_trip_of_cells(spark):
    rows = [("s", "a", 1.0), ("s", "b", None), ("t", "a", 3.0), ("t", "b", 4.0)]
    back = Matrix.from_cells(cells_of(spark, rows)).cells()
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_number_text(spark):
    texts = ["1.5", " 2 ", "abc", "", "NA", "NaN", "1d", "2.f", "1e3", "Inf", "-inf", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [r[0] for r in df.select(number(F.col("t"))).collect()]
    assert got == [1.5, 2.0, None, None, None, None, None, None, 1000.0, math.inf, -math.inf, None]
    with pytest.raises(PySparkException):
        df.where("t = 'abc'").select(number(F.col("t"), strict=True)).collect()
    assert df.where("t = 'NA'").select(number(F.col("t"), strict=True)).first()[0] is None


# alignment


def test_alignment(spark):
    matrix = Matrix.from_cells(cells_of(spark, [("a", "f", 1.0), ("b", "f", 2.0)]))
    some = spark.createDataFrame([("a",), ("z",)], "sample_id STRING")
    lenient = {r["sample_id"]: r["x"] for r in align.align_lenient(some, matrix).collect()}
    assert lenient == {"a": [1.0], "z": [None]}
    with pytest.raises(ValueError, match="'z'"):
        align.align_strict(some, matrix)
    twice = spark.createDataFrame([("a",), ("a",)], "sample_id STRING")
    with pytest.raises(ValueError, match="duplicate"):
        align.align_strict(twice, matrix)
    with pytest.raises(ValueError, match="'z'"):
        align.align_cells(some, cells_of(spark, [("a", "f", 1.0)]))


def test_unknown_feature_raises(spark):
    cells = cells_of(spark, [("a", "f", 1.0)])
    listed = spark.createDataFrame([("f",), ("g",)], "feature STRING")
    with pytest.raises(ValueError, match="1 selected features"):
        align.subset_features(cells, listed)


def test_salted_join_equals_plain(spark, monkeypatch):
    big = spark.range(5000).select((F.col("id") % 7).alias("k"), "id")
    side = spark.createDataFrame([(i, i * 10) for i in range(5)], "k LONG, v LONG")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(str, join_side(big, side, "k", how).collect()))
        with monkeypatch.context() as m:
            m.setattr("cohortgrid.cluster.BROADCAST_ROWS", 2)
            salted = sorted(map(str, join_side(big, side, "k", how).collect()))
        assert plain == salted


# quality


def test_half_missing_is_dropped(spark):
    rows = [(f"s{i}", "half", 1.0 if i < 2 else None) for i in range(4)]
    rows += [(f"s{i}", "kept", 1.0 if i < 3 else None) for i in range(4)]
    rows += [(f"s{i}", "none", None) for i in range(4)] + [("s0", "absent", 1.0)]
    flags = {r["feature"]: (r["n_missing"], r["kept"]) for r in quality.missingness(cells_of(spark, rows), 4).collect()}
    assert flags == {"half": (2, False), "kept": (1, True), "none": (4, False), "absent": (3, False)}
    left = quality.drop_half_missing(cells_of(spark, rows), 4).select("feature").distinct().collect()
    assert [r[0] for r in left] == ["kept"]


def test_all_missing_samples(spark):
    cells = cells_of(spark, [("a", "f", None), ("a", "g", None), ("b", "f", None), ("b", "g", 1.0)])
    assert {r["sample_id"] for r in quality.drop_all_missing(cells).collect()} == {"b"}


def test_near_zero_variance_rules(spark):
    n = 1000
    rows = []
    for i in range(n):
        rows += [(f"s{i}", "constant", 1.0), (f"s{i}", "missing", None), (f"s{i}", "rare", 1.0 if i == 0 else 0.0)]
        rows += [(f"s{i}", "border", float(i < 1 or i == 5)), (f"s{i}", "many", float(i))]
        rows += [(f"s{i}", "even", float(i % 2))]
        rows += [(f"s{i}", "gaps", 1.0 if i < 50 else None)]
    flags = {r["feature"]: r for r in quality.near_zero_variance(cells_of(spark, rows), n).collect()}
    assert {f for f, r in flags.items() if r["near_zero"]} == {"constant", "missing", "rare", "gaps"}
    assert flags["rare"]["freq_ratio"] == 999 and flags["rare"]["percent_unique"] == pytest.approx(0.2)
    assert flags["even"]["freq_ratio"] == 1 and flags["border"]["freq_ratio"] == 499


def test_varying_agrees_with_near_zero_variance(spark):
    n = 1000
    of = {
        "constant": lambda i: 1.0,
        "missing": lambda i: None,
        "rare": lambda i: float(i == 0),
        "border": lambda i: float(i < 1 or i == 5),
        "zeros": lambda i: -0.0 if i % 2 else 0.0,
        "many": float,
        "few": lambda i: float(i % 3),
        "gaps": lambda i: 1.0 if i < 50 else None,
        "ten": lambda i: float(max(0, i - 989)),
        "ninety": lambda i: float(max(0, i - 909)),
    }
    cells = cells_of(spark, [(f"s{i}", name, value(i)) for name, value in of.items() for i in range(n)])
    for total, ratio, percent in ((n, 899.0, 1.0), (n, 400.0, 1.0), (n, 5.0, 2.0), (n, 5.0, 20.0)):
        flags = quality.near_zero_variance(cells, total, ratio, percent).where("NOT near_zero")
        kept = quality.varying(cells, total, ratio, percent)
        assert sorted(r["feature"] for r in kept.collect()) == sorted(r["feature"] for r in flags.collect())


def test_wide_vectors_unfold_by_runs_to_the_same_cells(spark):
    width = 2 * 4096 + 5
    rows = [(f"s{i}", [None if (i + j) % 7 == 0 else float(i * j) for j in range(width)]) for i in range(6)]
    rows += [("empty", None)]
    df = spark.createDataFrame(rows, "sample_id STRING, x ARRAY<DOUBLE>")
    together = unfolded(df, "x", width)
    assert together.schema.names == ["sample_id", "ord", "value"]
    plain = unfolded(df, "x", width, together=False)
    assert together.count() == 6 * width
    assert not together.exceptAll(plain).count() and not plain.exceptAll(together).count()


def test_ranks_by_ranges_equal_the_window(spark):
    rows = [(c, f"f{i:04}", float((i * 37) % 11), float((i * 53) % 7)) for c in "ab" for i in range(700)]
    tests = spark.createDataFrame(rows + [("c", "f", None, 1.0)], "contrast STRING, feature STRING, p DOUBLE, logfc DOUBLE")
    window = Window.partitionBy("contrast").orderBy("p", F.desc("logfc"), "feature")
    wanted = tests.withColumn("rank", F.row_number().over(window))
    got = contrasts.ranked_table(tests).select(wanted.columns)
    assert got.count() == len(rows) + 1 and not wanted.exceptAll(got).count()


def test_many_markers_rank_like_few(spark):
    rows = [(c, f"f{i:04}", float((i * 37) % 101 - 50), float(i % 3)) for c in "ab" for i in range(1500)]
    table = spark.createDataFrame(rows, "class STRING, feature STRING, logfc DOUBLE, class_diff DOUBLE")
    few = contrasts.top_markers(table, 0.5, 900)
    many = contrasts.top_markers(table, 0.5, 1200).select(few.columns)
    assert many.count() == 2000 and few.count() == 1800
    assert not few.exceptAll(many.where("rank <= 900")).count()


def test_scalers(spark):
    cells = cells_of(spark, [("a", "f", 1.0), ("b", "f", 3.0), ("c", "f", None), ("a", "g", 2.0), ("b", "g", 2.0), ("c", "g", 2.0)])
    sample = {r["feature"]: (r["mean"], r["sd"]) for r in quality.scaler(cells, "sample").collect()}
    population = {r["feature"]: (r["mean"], r["sd"]) for r in quality.scaler(cells, "population").collect()}
    assert sample["f"] == (2.0, pytest.approx(math.sqrt(2))) and sample["g"] == (2.0, 0.0)
    assert population["f"] == (2.0, 1.0) and population["g"] == (2.0, 1.0)
    assert quality.scaler(cells, "none").where("feature = 'f'").first()[1:] == (0.0, 1.0)
    with pytest.raises(ValueError):
        quality.scaler(cells, "other")


# paired markers


def pair_cells(spark, table):
    """table: {feature: [(tumor, normal), ...]}"""
    rows = []
    for feature, pairs in table.items():
        for i, (t, n) in enumerate(pairs):
            rows += [(f"p{i}_tumor", feature, t), (f"p{i}_normal.tissue", feature, n)]
    return cells_of(spark, rows)


def tumors_of(spark, n, types=None):
    return spark.createDataFrame([(f"p{i}_tumor", types[i] if types else "t") for i in range(n)], "sample_id STRING, cancer_type STRING")


def chosen(df):
    return {r["feature"]: r["n_over"] for r in df.collect()}


def test_paired_rules(spark):
    cells = pair_cells(
        spark,
        {
            "three": [(1.0, 0.0)] * 3,
            "two": [(1.0, 0.0), (1.0, 0.0), (0.0, 0.0)],
            "other_two": [(0.0, 0.0), (1.0, 0.0), (1.0, 0.0)],
            "equal": [(0.5, 0.0)] * 3,
            "poisoned": [(1.0, 0.0), (1.0, 0.0), (None, 0.0)],
            "chrX:1": [(1.0, 0.0)] * 3,
            "far_chrM": [(1.0, 0.0)] * 3,
        },
    )
    tumors = tumors_of(spark, 3)
    assert chosen(paired.paired_markers(cells, tumors, 0.5, 1)) == {"three": 3}
    assert chosen(paired.paired_markers(cells, tumors, 0.5, 2)) == {"three": 3, "two": 2, "other_two": 2}
    assert chosen(paired.paired_markers(cells, tumors, 0.5, 100)) == {"three": 3, "two": 2, "other_two": 2}
    matrix = Matrix.from_cells(cells)
    for k in (1, 2, 100):
        assert chosen(paired.paired_markers(matrix, tumors, 0.5, k)) == chosen(paired.paired_markers(cells, tumors, 0.5, k))


def test_cells_and_matrix_leave_out_the_same_sparse_markers(spark):
    cells = pair_cells(spark, {"up": [(1.0, 0.0)] * 2, "sparse": [(1.0, 0.0)] * 2})
    cells = cells.unionByName(cells_of(spark, [(f"x{i}", "up", 0.0) for i in range(5)]))
    tumors = tumors_of(spark, 2).withColumn("cancer_type", F.lit("liver_cancer"))
    for data in (cells, Matrix.from_cells(cells)):
        got = studies.discover_paired("liver.cancer.study", tumors, data, 0.5, 5)
        assert [r["feature"] for r in got.collect()] == ["up"]


def test_absent_row_poisons_too(spark):
    cells = pair_cells(spark, {"a": [(1.0, 0.0)] * 2, "b": [(1.0, 0.0)] * 2}).where(
        "NOT (sample_id = 'p1_normal.tissue' AND feature = 'b')"
    )
    assert chosen(paired.paired_markers(cells, tumors_of(spark, 2), 0.5, 5)) == {"a": 2}


def test_missing_partner_raises(spark):
    cells = pair_cells(spark, {"a": [(1.0, 0.0)] * 2}).where("sample_id <> 'p1_normal.tissue'")
    with pytest.raises(ValueError, match="paired samples"):
        paired.paired_markers(cells, tumors_of(spark, 2), 0.5, 5)


def test_types_choose_for_themselves(spark):
    cells = pair_cells(spark, {"a": [(1.0, 0.0), (0.0, 0.0)], "b": [(0.0, 0.0), (1.0, 0.0)]})
    types = ["lung_cancer", "liver_cancer"]
    tumors = tumors_of(spark, 2, types)
    by_type = paired.paired_markers(cells, tumors, 0.5, 1, "cancer_type").collect()
    assert {(r["grp"], r["feature"]) for r in by_type} == {("lung_cancer", "a"), ("liver_cancer", "b")}
    liver = studies.discover_paired("liver.cancer.study", tumors, cells, 0.5, 1, by_type=True)
    assert [r["feature"] for r in liver.collect()] == ["b"]
    every = studies.discover_paired("liver.cancer.study", tumors, cells, 0.5, 1)
    assert sorted(r["feature"] for r in every.collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="not a tissue study"):
        studies.discover_paired("multi.cancer.study_typing", tumors, cells, 0.5, 1)


# one-vs-rest


def class_cells(spark, table):
    """table: {feature: {class: [values]}}; sample ids are class + position."""
    rows, classes = [], {}
    for feature, groups in table.items():
        for c, values in groups.items():
            for i, v in enumerate(values):
                rows.append((f"{c}{i}", feature, v))
                classes[f"{c}{i}"] = c
    annotation = spark.createDataFrame(sorted(classes.items()), "sample_id STRING, class STRING")
    return cells_of(spark, rows), annotation


def test_others_are_pooled_and_logfc_is_a_sum(spark):
    cells, annotation = class_cells(spark, {"f": {"a": [4.0], "b": [1.0, 1.0, 1.0], "c": [3.0, None]}})
    table = contrasts.effects_table(cells, annotation, ["a", "b", "c"])
    row = table.where("class = 'a'").first()
    assert row["logfc"] == pytest.approx(4 - 1 - 3) and row["others_mean"] == pytest.approx(6 / 4)
    assert (row["class_na"], row["others_na"]) == (0, 1)
    assert row["contrast"] == "a-b-c"


def test_feature_without_a_class_is_dropped(spark):
    cells, annotation = class_cells(spark, {"f": {"a": [1.0, 2.0], "b": [None, None]}, "g": {"a": [1.0, 2.0], "b": [3.0, 3.0]}})
    profile = contrasts.profile_matrix(cells, annotation, ["a", "b"])
    assert [r["feature"] for r in profile.collect()] == ["g"]


def test_two_classes_keep_positive_estimates(spark):
    cells, annotation = class_cells(spark, {"f": {"a": [1.0, 2.0], "b": [5.0, 6.0]}})
    rows = contrasts.effects_table(cells, annotation, ["a", "b"]).collect()
    assert [(r["class"], r["logfc"]) for r in rows] == [("b", 4.0)]


def test_top_markers_filters_and_breaks_ties_by_name(spark):
    both = {"a": [3.0, 3.0], "b": [0.0, 0.0], "c": [0.0, 0.0]}
    small = {"a": [0.5, 0.5], "b": [0.0, 0.0], "c": [0.0, 0.0]}
    cells, annotation = class_cells(spark, {"z": both, "y": both, "chrX:q": both, "q_chrX": both, "small": small})
    table = contrasts.effects_table(cells, annotation, ["a", "b", "c"])
    top = contrasts.top_markers(table, 0.5, 2).where("class = 'a'").orderBy("rank")
    assert [r["feature"] for r in top.collect()] == ["q_chrX", "y"]


def test_contrast_builders():
    classes = ["a", "b", "c"]
    assert [(k.name, k.coefs) for k in contrasts.one_vs_rest(classes)][0] == ("a-b-c", (1, -1, -1))
    assert [k.name for k in contrasts.one_vs_rest(classes, 2)] == ["a+b-c", "a+c-b", "b+c-a"]
    assert [k.name for k in contrasts.pairwise(classes)] == ["a-b", "a-c", "b-a", "b-c", "c-a", "c-b"]
    with pytest.raises(ValueError):
        contrasts.one_vs_rest(classes, 3)


def test_adjusted_p_against_definition(spark):
    import random

    rng = random.Random(3)
    rows = [(i, "k" if i % 3 else "m", rng.choice([1.0, 0.01, rng.random(), rng.random() ** 4])) for i in range(900)]
    tests = spark.createDataFrame(rows, "id INT, contrast STRING, p DOUBLE")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep several ranges per group
    try:
        got = {r["id"]: r["adj_p"] for r in contrasts.adjust_bh(tests).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for group in ("k", "m"):
        mine = sorted((p, i) for i, g, p in rows if g == group)
        m, low = len(mine), 1.0
        for rank in range(m, 0, -1):
            p, i = mine[rank - 1]
            low = min(low, p * m / rank)
            assert got[i] == pytest.approx(low, rel=1e-12)


def test_exact_median(spark):
    for n in (1, 2, 5, 1000, 1001):
        df = spark.range(n).select((F.hash("id") % 1000 / 7.0).alias("v"))
        values = sorted(r[0] for r in df.collect())
        want = (values[(n - 1) // 2] + values[n // 2]) / 2
        assert contrasts.exact_median(df, "v") == pytest.approx(want)


def test_marker_difference(spark):
    a = spark.createDataFrame([("f",), ("g",), ("g",)], "feature STRING")
    b = spark.createDataFrame([("f",), ("h",)], "feature STRING")
    assert [r[0] for r in paired.marker_difference(a, b).collect()] == ["g"]


# scores


def test_score_rules(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.5],), ([1.0, 0.0, 0.0],), ([0.0, 0.0, 0.0],)], "s ARRAY<DOUBLE>")
    rows = df.select(
        top_label(F.col("s"), ["a", "b", "c"]).alias("label"), top_ratio(F.col("s")).alias("ratio"), share_of_sum(F.col("s")).alias("p")
    ).collect()
    assert [r["label"] for r in rows] == ["b", "a", "a"]
    assert rows[0]["ratio"] == 1.0 and rows[1]["ratio"] == math.inf
    assert rows[2]["p"] == [0.0, 0.0, 0.0]


def test_probabilities_sum_to_one(spark):
    df = spark.range(200).select(F.array(*[F.sin(F.col("id") * i) * 9 for i in range(1, 5)]).alias("s"))
    checked = df.select(probabilities(F.col("s")).alias("p")).select(
        F.aggregate("p", F.lit(0.0), lambda a, v: a + v).alias("total"), top_ratio(F.col("p")).alias("ratio")
    )
    assert checked.where("abs(total - 1) > 1e-12 OR ratio < 1").isEmpty()


def test_require_present_counts_all(spark):
    a = spark.createDataFrame([(f"x{i}",) for i in range(9)], "k STRING")
    with pytest.raises(ValueError, match="9 things"):
        require_present(a, a.where("k = 'none'"), "k", "things")
