"""One query per operator over the driver tables. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalog import views
from cohortgrid.cluster import durable, scratch_path
from cohortgrid.functions.scores import top_label
from cohortgrid.matrix import Matrix, number
from cohortgrid.operators import align, cohort, contrasts, linear, mixture, moments, paired, quality, reduce
from cohortgrid.operators.probability import reorder_scores, with_probabilities
from cohortgrid.plans import studies
from cohortgrid.sources import files
from cohortgrid.sources.files import matrix_of_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SPLIT = "split:test"
CUTOFF = 0.02
PAIR_CUTOFF = 0.1
PAIR_TOP = 5
PER_CLASS = 6


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Round, and turn a negative zero into zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def class_annotation(spark, sf_dir) -> DataFrame:
    train, _ = cohort.split_exact(views.embedding_samples(spark, sf_dir), SPLIT)
    return train.select("sample_id", "class")


# Matrix forms and casts


@query
def unpivot_cells(spark, sf_dir):
    cells = views.embedding_matrix(spark, sf_dir).cells()
    return cells.select("sample_id", "feature", rounded("value", 8).alias("value"))


@query
def pivot_vectors(spark, sf_dir):
    matrix = Matrix.from_cells(durable(views.paired_cells(spark, sf_dir, poisoned=True)))
    names = [n.replace("#", "_").lower() for n in matrix.names()]
    return matrix.vectors.select(
        "sample_id", *[rounded(F.get("x", F.lit(i)), 8).alias(n) for i, n in enumerate(names)]
    )


@query
def lenient_cast(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    digits = F.regexp_extract("props", r"([0-9]+)", 1)
    return events.select(
        "event_id",
        number(F.col("props")).alias("from_props"),
        number(digits).alias("from_digits"),
        number(F.concat(digits, F.lit("d"))).alias("from_suffixed"),
        number(F.concat(F.lit(" "), digits, F.lit(".5e1"))).alias("from_exponent"),
    )


def csv_summary(spark, sf_dir, repeats, quoted_every):
    """The embedding matrix written as CSV text, every vector repeats times in a row, and read back. Ids hold a comma
    and a quote, and some values are quoted."""
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    width = e.select(F.size("x")).first()[0] * repeats
    header = ",".join(["id", *[f'"f,{i}"' for i in range(1, width + 1)]])
    values = F.flatten(F.array_repeat("x", repeats))

    def text(v, i):
        return F.when(i % quoted_every == 0, F.concat(F.lit('"'), v.cast("string"), F.lit('"'))).when(
            i % 7 == 3, F.lit("none")
        ).otherwise(v.cast("string"))

    line = F.concat(F.lit('"s,""'), F.col("vec_id"), F.lit('",'), F.array_join(F.transform(values, text), ","))
    matrix = matrix_of_lines(e.select(line.alias("line")), header)
    known = F.size(F.filter("x", lambda v: v.isNotNull()))
    weighted = F.aggregate(
        F.transform("x", lambda v, i: F.coalesce(v, F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda a, v: a + v
    )
    return matrix.vectors.select(
        "sample_id", F.size("x").alias("width"), known.alias("n_known"), rounded(weighted, 3).alias("weighted")
    )


@query
def csv_matrix(spark, sf_dir):
    return csv_summary(spark, sf_dir, 1, 3)


@query
def csv_matrix_wide(spark, sf_dir):
    return csv_summary(spark, sf_dir, 33, 5)


# Cohort


@query
def split_counts(spark, sf_dir):
    return cohort.split_counts(views.embedding_samples(spark, sf_dir), "split_gaps:test", "class")


@query
def split_null_ci(spark, sf_dir):
    return cohort.split_counts(views.embedding_samples(spark, sf_dir), "split_gaps:TEST", "class", any_case=True)


@query
def class_weights(spark, sf_dir):
    samples = views.embedding_samples(spark, sf_dir)
    train, _ = cohort.split_exact(samples, SPLIT)
    classes = cohort.sorted_classes(samples, "class")
    weights = cohort.balanced_weights(train, "class")
    return weights.select("class", cohort.class_code("class", classes).alias("code"), "n", rounded("weight").alias("weight"))


@query
def label_exclude(spark, sf_dir):
    samples = views.embedding_samples(spark, sf_dir)
    coded = samples.withColumn("code", cohort.status_code())
    kept = cohort.without_class(coded, "class", "c3")
    return kept.groupBy("class", "cancer_status", "code").agg(F.count("*").alias("n"))


@query
def feature_subset(spark, sf_dir):
    matrix = views.embedding_matrix(spark, sf_dir)
    return align.subset_features(matrix.cells(), high_features(matrix)).select("sample_id", "feature", rounded("value", 8).alias("value"))


def high_features(matrix: Matrix) -> DataFrame:
    """Features with a positive mean: a feature list that comes from the data."""
    means = matrix.positions().groupBy("ord").agg(F.avg("value").alias("m")).where("m > 0")
    return durable(matrix.named(means).select("feature"))


def vector_summary(df: DataFrame, *columns: str) -> DataFrame:
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    known = F.size(F.filter("x", lambda v: v.isNotNull()))
    return df.select(*columns, F.size("x").alias("width"), known.alias("n_known"), rounded(total).alias("total"))


@query
def align_strict(spark, sf_dir):
    samples = views.embedding_samples(spark, sf_dir)
    aligned = align.align_strict(samples, views.gappy_matrix(spark, sf_dir))
    return vector_summary(aligned, "sample_id", "class", "split")


@query
def align_lenient(spark, sf_dir):
    """The annotation lists customers as well, which have no matrix row."""
    samples = views.embedding_samples(spark, sf_dir).select("sample_id", "class")
    others = views.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("k"), F.col("c_custkey")).alias("sample_id"), F.col("c_mktsegment").alias("class")
    )
    aligned = align.align_lenient(samples.unionByName(others), views.embedding_matrix(spark, sf_dir))
    return vector_summary(aligned, "sample_id", "class")


@query
def attach_scores(spark, sf_dir):
    """Scores exist for test samples only; every annotation row is kept."""
    samples = views.embedding_samples(spark, sf_dir)
    _, test = cohort.split_exact(samples, SPLIT)
    scored = align.align_strict(test.select("sample_id"), views.embedding_matrix(spark, sf_dir))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return align.attach_scores(samples, scored.select("sample_id", rounded(total).alias("score"))).drop("split_gaps")


# Quality


@query
def missing_filter(spark, sf_dir):
    matrix = views.gappy_matrix(spark, sf_dir)
    n = matrix.vectors.count()
    flags = durable(quality.feature_missingness(moments.matrix_moments(matrix), n))
    left = quality.drop_features(matrix, flags)
    remaining = left.features.select("feature", F.lit(left.vectors.count()).alias("n_cells"))
    return matrix.named(flags).join(remaining, "feature", "left")


@query
def missing_samples(spark, sf_dir):
    matrix = views.gappy_matrix(spark, sf_dir)
    return quality.sample_missingness(quality.drop_empty_samples(matrix))


@query
def near_zero_variance(spark, sf_dir):
    cells = views.customer_cells(spark, sf_dir)
    n = views.table(spark, sf_dir, "customer").count()
    flags = quality.near_zero_variance(cells, n)
    return flags.select(
        "feature", rounded("freq_ratio").alias("freq_ratio"), rounded("percent_unique").alias("percent_unique"),
        "n_distinct", "near_zero",
    )


def standardized(spark, sf_dir, kind):
    samples = views.embedding_samples(spark, sf_dir)
    matrix = views.embedding_matrix(spark, sf_dir)
    train, _ = cohort.split_exact(samples, SPLIT)
    fitted = quality.feature_scaler(moments.matrix_moments(matrix, train.select("sample_id")), kind)
    scaled = quality.standardize_matrix(matrix, fitted).cells()
    return scaled.select("sample_id", "feature", rounded("value").alias("value"))


@query
def standardize_sample(spark, sf_dir):
    return standardized(spark, sf_dir, "sample")


@query
def standardize_population(spark, sf_dir):
    return standardized(spark, sf_dir, "population")


@query
def standardize_center(spark, sf_dir):
    return standardized(spark, sf_dir, "center")


# Paired markers


@query
def paired_markers_all(spark, sf_dir):
    cells = durable(views.paired_cells(spark, sf_dir, poisoned=True, chromosomes=True))
    tumors = views.tumor_samples(spark, sf_dir)
    return paired.paired_markers(cells, tumors, PAIR_CUTOFF, PAIR_TOP).select("feature", "n_over")


@query
def paired_markers_vectors(spark, sf_dir):
    """The same choice from vectors: pairs meet before their cells unfold."""
    cells = durable(views.paired_cells(spark, sf_dir, poisoned=True, chromosomes=True))
    matrix = Matrix.from_cells(cells).written()
    tumors = views.tumor_samples(spark, sf_dir)
    return paired.paired_markers(matrix, tumors, PAIR_CUTOFF, PAIR_TOP).select("feature", "n_over")


@query
def paired_markers_by_type(spark, sf_dir):
    cells = durable(views.paired_cells(spark, sf_dir, poisoned=True, chromosomes=True))
    tumors = views.tumor_samples(spark, sf_dir)
    chosen = paired.paired_markers(cells, tumors, PAIR_CUTOFF, PAIR_TOP, "cancer_type")
    return chosen.select(F.col("grp").alias("cancer_type"), "feature", "n_over")


@query
def paired_markers_union(spark, sf_dir):
    cells = durable(views.paired_cells(spark, sf_dir))
    tumors = views.tumor_samples(spark, sf_dir)
    return paired.marker_union(paired.paired_markers(cells, tumors, PAIR_CUTOFF, PAIR_TOP, "cancer_type"))


# One-vs-rest markers


def profile_of(spark, sf_dir, matrix: Matrix) -> tuple[DataFrame, list[str]]:
    annotation = class_annotation(spark, sf_dir)
    classes = cohort.sorted_classes(annotation, "class")
    return contrasts.profile_matrix(matrix, annotation, classes), classes


@query
def class_effects(spark, sf_dir):
    profile, classes = profile_of(spark, sf_dir, views.gappy_matrix(spark, sf_dir))
    annotation = class_annotation(spark, sf_dir)
    sizes = contrasts.class_sizes(annotation)
    effects = contrasts.class_effects(profile, classes, sizes)
    return effects.select(
        "feature", "class", "n", "class_na", "others_na", "df",
        *[rounded(c, 8).alias(c) for c in ("class_mean", "others_mean", "class_diff", "s2")],
    )


def contrast_rows(estimates: DataFrame) -> DataFrame:
    return estimates.select(
        "feature", "contrast", rounded("logfc", 8).alias("logfc"), rounded("unscaled", 8).alias("unscaled")
    )


@query
def ovr_contrasts(spark, sf_dir):
    profile, classes = profile_of(spark, sf_dir, views.embedding_matrix(spark, sf_dir))
    return contrast_rows(contrasts.estimate(profile, contrasts.one_vs_rest(classes)))


@query
def two_positive_contrasts(spark, sf_dir):
    profile, classes = profile_of(spark, sf_dir, views.embedding_matrix(spark, sf_dir))
    return contrast_rows(contrasts.estimate(profile, contrasts.one_vs_rest(classes, 2)))


@query
def pairwise_contrasts(spark, sf_dir):
    profile, classes = profile_of(spark, sf_dir, views.embedding_matrix(spark, sf_dir))
    return contrast_rows(contrasts.estimate(profile, contrasts.pairwise(classes)))


def marker_rows(spark, sf_dir, per_class=PER_CLASS) -> DataFrame:
    annotation = class_annotation(spark, sf_dir)
    classes = cohort.sorted_classes(annotation, "class")
    matrix = views.embedding_matrix(spark, sf_dir, chromosomes=True)
    table = contrasts.effects_table(matrix, annotation, classes)
    return contrasts.top_markers(table, CUTOFF, per_class)


@query
def ovr_markers_many(spark, sf_dir):
    """More markers per class than Spark cuts before a shuffle."""
    return marker_rows(spark, sf_dir, 2000).select("class", "feature", "rank", rounded("logfc", 8).alias("logfc"))


@query
def ovr_markers(spark, sf_dir):
    return marker_rows(spark, sf_dir).select(
        "class", "feature", "rank", rounded("logfc", 8).alias("logfc"), rounded("class_diff", 8).alias("class_diff")
    )


@query
def ovr_marker_counts(spark, sf_dir):
    return contrasts.marker_counts(marker_rows(spark, sf_dir))


@query
def ovr_markers_minus(spark, sf_dir):
    """Plasma markers without those that the embedding mean already separates."""
    unwanted = high_features(views.embedding_matrix(spark, sf_dir, chromosomes=True))
    return paired.marker_difference(marker_rows(spark, sf_dir), unwanted)


@query
def two_class_markers(spark, sf_dir):
    train, _ = cohort.split_exact(views.embedding_samples(spark, sf_dir), SPLIT)
    annotation = train.select("sample_id", F.col("cancer_status").alias("class"))
    matrix = views.embedding_matrix(spark, sf_dir, chromosomes=True)
    table = contrasts.effects_table(matrix, annotation, ["cancer", "normal"])
    ranked = contrasts.top_markers(table, 0.005, PER_CLASS)
    return ranked.select("class", "feature", "rank", rounded("logfc", 8).alias("logfc"))


def moderated(spark, sf_dir) -> DataFrame:
    """One-vs-rest tests of values times 10, so that some contrasts pass the threshold of 1."""
    profile, classes = profile_of(spark, sf_dir, views.embedding_matrix(spark, sf_dir, times=10.0))
    fitted = durable(profile)
    prior = contrasts.variance_prior(fitted)
    return contrasts.moderated_test(contrasts.estimate(fitted, contrasts.one_vs_rest(classes)), prior)


@query
def moderated_t(spark, sf_dir):
    adjusted = contrasts.decide(contrasts.adjust_bh(moderated(spark, sf_dir)))
    return adjusted.select(
        "feature", F.col("main").alias("class"), "decision",
        *[rounded(c).alias(c) for c in ("s2_post", "t", "p", "adj_p")],
    )


@query
def bh_adjust(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    p = F.col("o_totalprice") * 100 % 1000003 / 1000003
    tests = orders.select("o_orderkey", F.col("o_orderpriority").alias("contrast"), p.alias("p"))
    adjusted = contrasts.adjust_bh(tests)
    return adjusted.select("o_orderkey", "contrast", rounded("p", 9).alias("p"), rounded("adj_p", 9).alias("adj_p"))


@query
def ranked_tests(spark, sf_dir):
    """Place of every one-vs-rest test within its contrast, by p and then by size; p and logfc are rounded
    first, so that a place does not depend on the last digits."""
    tests = moderated(spark, sf_dir).withColumn("p", rounded("p")).withColumn("logfc", rounded("logfc"))
    return contrasts.ranked_table(tests).select(F.col("main").alias("class"), "feature", "p", F.col("rank").alias("place"))


# Reduction


def train_vectors(spark, sf_dir) -> tuple[DataFrame, Matrix]:
    matrix = views.embedding_matrix(spark, sf_dir)
    train, _ = cohort.split_exact(views.embedding_samples(spark, sf_dir), SPLIT)
    return align.align_strict(train.select("sample_id", "class", "cancer_status"), matrix), matrix


@query
def gram_matrix(spark, sf_dir):
    vectors, matrix = train_vectors(spark, sf_dir)
    vectors = durable(vectors)
    columns, (mean, sd) = range(matrix.width), reduce._scales(moments.vector_moments(vectors, matrix.width), "sample", matrix.width)
    gram = reduce.feature_gram(vectors, matrix.width, list(columns), mean, sd)
    return gram.select((F.col("row") + 1).alias("i"), F.posexplode("v").alias("j", "g")).select(
        "i", (F.col("j") + 1).alias("j"), rounded("g").alias("g")
    )


@query
def svd_project_top(spark, sf_dir):
    vectors, matrix = train_vectors(spark, sf_dir)
    model = reduce.fit_reduction(vectors.select("sample_id", "x"), matrix.width, 1)
    projected = matrix.vectors.select("sample_id", model.project("x").alias("z"))
    return projected.select("sample_id", rounded(F.get("z", F.lit(0)), 4).alias("pc1"))


@query
def pca_project_top(spark, sf_dir):
    vectors, matrix = train_vectors(spark, sf_dir)
    model = reduce.fit_reduction(vectors.select("sample_id", "x"), matrix.width, 1, "center", drop_near_zero=False)
    projected = matrix.vectors.select("sample_id", model.project("x").alias("z"))
    return projected.select("sample_id", rounded(F.get("z", F.lit(0)), 4).alias("pc1"))


# Classifiers


def binary_fit(spark, sf_dir, classifier=linear.BINARY_CLASSIFIER, weight=None):
    vectors, matrix = train_vectors(spark, sf_dir)
    labelled = vectors.withColumn("label", cohort.status_code())
    if weight is not None:
        labelled = labelled.withColumn("row_weight", weight)
    model = linear.fit_binary(
        labelled, matrix.width, classifier=classifier, weight=None if weight is None else "row_weight"
    )
    return matrix.vectors.select("sample_id", model.score("x").alias("score")), model, labelled


@query
def svm_binary(spark, sf_dir):
    scores, _, _ = binary_fit(spark, sf_dir)
    return scores.select("sample_id", rounded("score", 4).alias("score"))


@query
def svm_binary_row_weights(spark, sf_dir):
    weight = 1 + F.substring("sample_id", 2, 20).cast("long") % 3
    scores, _, _ = binary_fit(spark, sf_dir, weight=weight)
    return scores.select("sample_id", rounded("score", 4).alias("score"))


@query
def svm_binary_l1(spark, sf_dir):
    scores, _, _ = binary_fit(spark, sf_dir, "LinearSVC_l1_c1")
    return scores.select("sample_id", rounded("score", 4).alias("score"))


@query
def svm_ovr(spark, sf_dir):
    vectors, matrix = train_vectors(spark, sf_dir)
    classes = cohort.sorted_classes(vectors, "class")
    model = linear.fit_one_vs_rest(vectors.withColumn("code", cohort.class_code("class", classes)), matrix.width, classes)
    scored = matrix.vectors.select("sample_id", model.scores("x").alias("scores"))
    spread = scored.select("sample_id", F.posexplode("scores").alias("k", "score"))
    names = F.array(*[F.lit(c) for c in classes])
    return spread.select("sample_id", F.get(names, F.col("k")).alias("class"), rounded("score", 4).alias("score"))


def class_mean_model(spark, sf_dir) -> tuple[linear.LinearModel, Matrix]:
    """Fixed weights: the mean vector of each class, no bias."""
    import numpy as np

    vectors, matrix = train_vectors(spark, sf_dir)
    means = vectors.select("class", F.posexplode("x")).groupBy("class", "pos").agg(F.avg("col").alias("m"))
    rows = means.orderBy("class", "pos").collect()
    classes = sorted({r["class"] for r in rows})
    weights = np.array([r["m"] for r in rows]).reshape(len(classes), matrix.width)
    return linear.LinearModel(weights, np.zeros(len(classes)), tuple(classes)), matrix


@query
def score_fixed_weights(spark, sf_dir):
    model, matrix = class_mean_model(spark, sf_dir)
    scored = matrix.vectors.select("sample_id", model.scores("x").alias("s"))
    label = top_label(F.col("s"), list(model.classes))
    return scored.select(
        "sample_id", rounded(F.array_max("s")).alias("best"), rounded(F.array_min("s")).alias("worst"), label.alias("label")
    )


@query
def probability_post(spark, sf_dir):
    model, matrix = class_mean_model(spark, sf_dir)
    backwards = list(reversed(model.classes))
    scored = matrix.vectors.select("sample_id", model.scores("x").alias("scores"))
    flipped = scored.withColumn("scores", reorder_scores("scores", list(model.classes), backwards))
    table = with_probabilities(
        flipped.withColumn("scores", reorder_scores("scores", backwards, list(model.classes))), list(model.classes)
    )
    return table.select(
        "sample_id", *[rounded(c).alias(c) for c in (*model.classes, "ratio")], "pred_label"
    )


# Mixture


@query
def deconv_stats(spark, sf_dir):
    profiles, tissues = views.mixture_profiles(spark, sf_dir)
    vectors = mixture.profile_vectors(profiles, tissues)
    stats = mixture.mixture_statistics(durable(views.mixture_cells(spark, sf_dir)), vectors, tissues)
    pairs = [(i, j) for i in range(len(tissues)) for j in range(i, len(tissues))]
    return stats.select(
        "sample_id", "n", rounded("bb", 5).alias("bb"),
        *[rounded(F.get("ab", F.lit(i)), 5).alias(f"ab_{t.lower().replace(' ', '_')}") for i, t in enumerate(tissues)],
        *[rounded(F.get("aa", F.lit(n)), 5).alias(f"aa_{i}_{j}") for n, (i, j) in enumerate(pairs)],
    )


@query
def deconv_all_samples(spark, sf_dir):
    """From vectors with missing markers, and a sample that lacks all."""
    profiles, tissues = views.mixture_profiles(spark, sf_dir)
    cells = views.mixture_cells(spark, sf_dir)
    gap = (F.length("feature") * 7 + F.length("sample_id") * 3) % 5 == 0
    cells = cells.withColumn("value", F.when(~gap & (F.col("sample_id") != views.EMPTY_SAMPLE), F.col("value")))
    vectors = mixture.profile_vectors(profiles, tissues)
    stats = mixture.mixture_statistics(Matrix.from_cells(durable(cells)), vectors, tissues)
    pairs = [(i, j) for i in range(len(tissues)) for j in range(i, len(tissues))]
    return stats.select(
        "sample_id", "n", rounded("bb", 5).alias("bb"),
        *[rounded(F.get("ab", F.lit(i)), 5).alias(f"ab_{t.lower().replace(' ', '_')}") for i, t in enumerate(tissues)],
        *[rounded(F.get("aa", F.lit(n)), 5).alias(f"aa_{i}_{j}") for n, (i, j) in enumerate(pairs)],
    )


def fractions(spark, sf_dir, mode, digits=6):
    profiles, tissues = views.mixture_profiles(spark, sf_dir)
    vectors = mixture.profile_vectors(profiles, tissues)
    table = mixture.deconvolve(durable(views.mixture_cells(spark, sf_dir)), vectors, tissues, mode)
    return table.select(
        "sample_id", *[rounded(F.col(f"`{t}`"), digits).alias(t.lower().replace(" ", "_")) for t in sorted(tissues)]
    )


@query
def deconv_fractions(spark, sf_dir):
    return fractions(spark, sf_dir, "constrained_ls")


@query
def deconv_posterior_two(spark, sf_dir):
    """The posterior mean of two parts, the first two regions."""
    profiles, tissues = views.mixture_profiles(spark, sf_dir)
    two = tissues[:2]
    vectors = mixture.profile_vectors(profiles.where(F.col("tissue").isin(two)), two)
    table = mixture.deconvolve(durable(views.mixture_cells(spark, sf_dir)), vectors, two, "posterior_mean")
    return table.select("sample_id", *[rounded(F.col(f"`{t}`"), 5).alias(t.lower().replace(" ", "_")) for t in two])


@query
def deconv_posterior_drawn(spark, sf_dir):
    """Laws of the seeded draws for all regions: fractions above 0 that sum to 1."""
    drawn = fractions(spark, sf_dir, "posterior_mean", 12).alias("d")
    names = [c for c in drawn.columns if c != "sample_id"]
    total = sum(F.col(f"d.{c}") for c in names)
    inside = F.least(*[F.col(f"d.{c}") for c in names]) > 0
    return drawn.select("sample_id", (F.abs(total - 1) < 1e-9).alias("whole"), inside.alias("inside"))


@query
def deconv_posterior(spark, sf_dir):
    return fractions(spark, sf_dir, "posterior_mean")


# Files: written to the shared folder and read back


@query
def matrix_file_gzip(spark, sf_dir):
    """The embedding matrix as gzipped CSV files."""
    matrix = views.embedding_matrix(spark, sf_dir)
    path = scratch_path(spark, "matrix.csv.gz")
    wide = matrix.vectors.select("sample_id", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(matrix.names())])
    wide.repartition(3).write.csv(path, header=True, compression="gzip")
    cells = files.read_matrix(spark, path).cells()
    return cells.select("sample_id", "feature", rounded("value", 8).alias("value"))


def annotation_file(spark, sf_dir, strict) -> DataFrame:
    """Vector ids with zeros in front, a split that is sometimes missing, and words that only some readers take for
    missing."""
    samples = views.embedding_samples(spark, sf_dir)
    odd = F.when(F.col("class") == "c1", "null").when(F.col("class") == "c2", "NaN").when(F.col("class") == "c3", "NA").otherwise("1e3")
    path = scratch_path(spark, "samples.csv")
    files.write_predictions(samples.select(F.concat(F.lit("00"), "sample_id").alias("id"), "split_gaps", odd.alias("odd")), path)
    return files.read_annotation(spark, path, strict)


@query
def annotation_file_lenient(spark, sf_dir):
    return annotation_file(spark, sf_dir, False)


@query
def annotation_file_strict(spark, sf_dir):
    return annotation_file(spark, sf_dir, True)


@query
def list_files(spark, sf_dir):
    """Brands as a marker list, with blanks around and empty lines between: as names without them, and as lines."""
    brands = views.table(spark, sf_dir, "part").select("p_brand").distinct()
    lines = F.array(F.concat(F.lit("  "), "p_brand", F.lit(" ")), F.lit(""))
    path = scratch_path(spark, "markers.txt")
    files.write_markers(brands.select(F.explode(lines).alias("feature")), path)
    rows = [("names", n) for n in files.read_feature_list(spark, path)]
    rows += [("lines", n) for n in files.read_feature_list(spark, path, stripped=False)]
    return spark.createDataFrame(rows, "form STRING, feature STRING").groupBy("form", "feature").agg(F.count("*").alias("n"))


@query
def profile_file(spark, sf_dir):
    """Reference profiles as a CSV table, marker by tissue."""
    profiles, tissues = views.mixture_profiles(spark, sf_dir)
    path = scratch_path(spark, "profiles.csv")
    wide = profiles.groupBy("feature").pivot("tissue", tissues).agg(F.max("value"))
    wide.write.csv(path, header=True)
    vectors, names = files.read_profiles(spark, path)
    cells = vectors.select("feature", F.posexplode("a").alias("at", "value"))
    listed = F.array(*map(F.lit, names))
    return cells.select("feature", F.get(listed, F.col("at")).alias("tissue"), rounded("value", 8).alias("value")).where("value IS NOT NULL")


@query
def prediction_file(spark, sf_dir):
    """Scores with all their digits, labels that need quotes, missing values as NA."""
    orders = views.table(spark, sf_dir, "orders")
    label = F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.concat(F.col("o_orderpriority"), F.lit(', "x"')))
    path = scratch_path(spark, "predictions.csv")
    files.write_predictions(orders.select("o_orderkey", (F.col("o_totalprice") / 3).alias("score"), label.alias("label")), path)
    back = spark.read.csv(path, header=True, nullValue="NA", escape="\\")
    score = F.col("score").cast("double") == F.col("o_totalprice") / 3
    joined = back.join(orders.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_totalprice"), "o_orderkey")
    return joined.select("o_orderkey", score.alias("same"), "label")


@query
def fraction_file(spark, sf_dir):
    """Mixture fractions as a CSV table with sorted tissues."""
    profiles, tissues = views.mixture_profiles(spark, sf_dir)
    vectors = mixture.profile_vectors(profiles, tissues)
    path = scratch_path(spark, "fractions.csv")
    files.write_fractions(mixture.deconvolve(durable(views.mixture_cells(spark, sf_dir)), vectors, tissues), path)
    back = spark.read.csv(path, header=True)
    return back.select(
        "sample_id", *[rounded(F.col(f"`{t}`").cast("double")).alias(t.lower().replace(" ", "_")) for t in back.columns[1:]]
    )


@query
def strict_cast(spark, sf_dir):
    """Numbers and spelled-out missing values; any other text would raise."""
    events = views.table(spark, sf_dir, "events")
    digits = F.regexp_extract("props", r"([0-9]+)", 1)
    text = F.when(F.col("event_id") % 5 == 0, "NA").when(F.col("event_id") % 5 == 1, "nan").otherwise(F.concat(F.lit(" "), digits, F.lit(".25")))
    return events.select("event_id", number(text, strict=True).alias("value"))


# Studies


@query
def study_detection(spark, sf_dir):
    samples = views.embedding_samples(spark, sf_dir).select("sample_id", "class", "cancer_status", "split")
    table = studies.detection(samples, views.embedding_matrix(spark, sf_dir), SPLIT)
    score = "pred.score_multi.cancer"
    return table.withColumn(score, rounded(F.col(f"`{score}`"), 4))


@query
def study_detection_reduced(spark, sf_dir):
    """Detection on three components, as wide matrices get it on more."""
    samples = views.embedding_samples(spark, sf_dir).select("sample_id", "class", "cancer_status", "split")
    table = studies.binary_study(samples, views.embedding_matrix(spark, sf_dir), SPLIT, 3, "score")
    return table.withColumn("score", rounded("score", 4))


@query
def study_surveillance(spark, sf_dir):
    """Supplier pairs: tumor samples are the cancer status; odd suppliers train. A supplier that lacks lines of a brand
    gets the mean of the training samples there, because a study takes no vectors with missing values."""
    matrix = Matrix.from_cells(durable(views.paired_cells(spark, sf_dir))).written()
    tumor = F.col("sample_id").endswith("_tumor")
    key = F.regexp_extract("sample_id", r"^S(-?\d+)_", 1).cast("bigint")
    samples = matrix.vectors.select(
        "sample_id",
        F.when(tumor, "cancer").otherwise("normal").alias("cancer_status"),
        F.when(key % 2 == 1, "train").otherwise("test").alias("split"),
    )
    train, _ = cohort.split_exact(samples, SPLIT)
    scale = quality.feature_scaler(moments.matrix_moments(matrix, train.select("sample_id")), "center")
    table = studies.surveillance(samples, quality.fill_missing(matrix, scale), SPLIT)
    score = "pred.score_liver.cancer"
    return table.withColumn(score, rounded(F.col(f"`{score}`"), 4))


@query
def study_typing(spark, sf_dir):
    """Vectors of status cancer are typed by their class; the others are left out."""
    samples = views.embedding_samples(spark, sf_dir).select(
        "sample_id", "cancer_status", F.col("class").alias("cancer_type"), "split"
    )
    table = studies.typing(samples, views.embedding_matrix(spark, sf_dir), SPLIT)
    return round_doubles(table)


def round_doubles(table: DataFrame, digits: int = 4) -> DataFrame:
    return table.select(
        *[
            rounded(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`")
            for c, t in table.dtypes
        ]
    )


def marker_names(spark, sf_dir) -> list[str]:
    return sorted(r["feature"] for r in high_features(views.embedding_matrix(spark, sf_dir)).collect())


@query
def study_race(spark, sf_dir):
    samples = views.embedding_samples(spark, sf_dir).select("sample_id", F.col("class").alias("race"), "split")
    table = studies.race(samples, views.embedding_matrix(spark, sf_dir), SPLIT, marker_names(spark, sf_dir))
    return round_doubles(table)


def disease_study(spark, sf_dir, reduction):
    samples = views.embedding_samples(spark, sf_dir).select("sample_id", F.col("class").alias("disease_type"), "split_gaps")
    table = studies.disease(
        samples, views.embedding_matrix(spark, sf_dir), "split_gaps:TEST", marker_names(spark, sf_dir), reduction=reduction
    )
    return round_doubles(table)


@query
def study_disease(spark, sf_dir):
    return disease_study(spark, sf_dir, "none")


@query
def study_disease_reduced(spark, sf_dir):
    return disease_study(spark, sf_dir, "svd8")


@query
def study_disease_rotated(spark, sf_dir):
    """As many components as features: a rotation of the standardised features, which no score depends on."""
    return disease_study(spark, sf_dir, "svd64")


@query
def study_discovery_detection(spark, sf_dir):
    cells = durable(views.paired_cells(spark, sf_dir, poisoned=True, chromosomes=True))
    matrix = Matrix.from_cells(cells).written()
    tumors = views.tumor_samples(spark, sf_dir)
    return studies.discover_paired("multi.cancer.study_detection", tumors, matrix, PAIR_CUTOFF, PAIR_TOP)


@query
def paired_cells_sparse(spark, sf_dir):
    """As cells. Two samples without a pair for every paired one lack the even markers, which are left out, as
    they are from a matrix."""
    cells = durable(views.paired_cells(spark, sf_dir))
    odd = F.regexp_extract("feature", r"(\d+)$", 1).cast("int") % 2 == 1
    others = [cells.where(odd).withColumn("sample_id", F.concat(F.lit(name), "sample_id")) for name in ("A", "B")]
    tumors = views.tumor_samples(spark, sf_dir)
    cells = cells.unionByName(others[0]).unionByName(others[1])
    return studies.discover_paired("multi.cancer.study_detection", tumors, cells, PAIR_CUTOFF, PAIR_TOP)


@query
def study_discovery_disease(spark, sf_dir):
    samples = views.embedding_samples(spark, sf_dir).withColumn("disease_type", F.col("class"))
    matrix = views.gappy_matrix(spark, sf_dir)
    return studies.discover_one_vs_rest("liver.disease.study", samples, matrix, SPLIT, CUTOFF, PER_CLASS)


@query
def study_discovery_race(spark, sf_dir):
    samples = views.embedding_samples(spark, sf_dir).withColumn("race", F.col("class"))
    matrix = views.gappy_matrix(spark, sf_dir)
    unwanted = high_features(matrix)
    return studies.discover_one_vs_rest("race.study", samples, matrix.cells(), SPLIT, CUTOFF, PER_CLASS, unwanted)
