"""One-vs-rest and pairwise markers from a per-feature one-way linear model.

One pass over the cells gives count, sum and squared deviations per (feature, class); everything after
that works on one row per feature.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortgrid.cluster import durable, join_side
from cohortgrid.fixed import (
    MARKER_DIFF_CUTOFF,
    MARKERS_PER_CLASS,
    SEX_AND_MITO,
    TREAT_LFC,
    VARIANCE_FLOOR,
)
from cohortgrid.matrix import Matrix
from cohortgrid.operators.moments import matrix_moments
from cohortgrid.functions.special import digamma, digamma_of, inverse_trigamma, t_upper_tail, trigamma

MAX_CONTRASTS = 100_000


def class_profile(cells: DataFrame, key: str = "feature") -> DataFrame:
    """(key, c): c lists (class, n, total, ss, mean) by class, from cells with their class and value."""
    per_class = cells.groupBy(key, "class").agg(
        F.count("value").alias("n"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"),
        F.coalesce(F.var_pop("value") * F.count("value"), F.lit(0.0)).alias("ss"),
        F.avg("value").alias("mean"),
    )
    entry = F.struct("class", "n", "total", "ss", "mean")
    return per_class.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("c"))


def complete(profile: DataFrame, classes: list[str]) -> DataFrame:
    """Drop features that lack data in any class."""
    return profile.where((F.size("c") == len(classes)) & F.forall("c", lambda e: e["n"] > 0))


def class_sizes(annotation: DataFrame) -> dict[str, int]:
    return {r["class"]: r["count"] for r in annotation.groupBy("class").count().collect()}


def profile_matrix(data: Matrix | DataFrame, annotation: DataFrame, classes: list[str]) -> DataFrame:
    """Complete class profiles with residuals, from a matrix or from cells, of the annotated samples."""
    if isinstance(data, Matrix):
        by_position = matrix_moments(data, annotation.select("sample_id", "class"), "class")
        return residuals(data.named(complete(by_position, classes)))
    return residuals(complete(class_profile(join_side(data, annotation, "sample_id")), classes))


def residuals(profile: DataFrame) -> DataFrame:
    """Add s2 and df: residual variance and degrees of freedom of the one-way model."""
    n = F.aggregate("c", F.lit(0).cast("long"), lambda a, e: a + e["n"])
    ss = F.aggregate("c", F.lit(0.0), lambda a, e: a + e["ss"])
    df = n - F.size("c")
    return profile.withColumn("df", df).withColumn("s2", F.when(df > 0, F.try_divide(ss, df.cast("double"))))


@dataclass(frozen=True)
class Contrast:
    """A named row of coefficients over the sorted classes; main is the class it speaks for, if one."""

    name: str
    coefs: tuple[int, ...]
    main: str | None = None


def one_vs_rest(classes: list[str], positives: int = 1) -> list[Contrast]:
    """Each choice of `positives` classes plus, every other class minus (sums, not averages)."""
    if not 0 < positives < len(classes):
        raise ValueError("the number of positive classes must be below the number of classes")
    if math.comb(len(classes), positives) > MAX_CONTRASTS:
        raise ValueError("too many class combinations")
    rows = []
    for plus in combinations(classes, positives):
        name = "+".join(plus) + "".join(f"-{c}" for c in classes if c not in plus)
        rows.append(
            Contrast(name, tuple(1 if c in plus else -1 for c in classes), plus[0] if positives == 1 else None)
        )
    return rows


def pairwise(classes: list[str]) -> list[Contrast]:
    """A minus B for every ordered pair."""
    if len(classes) * (len(classes) - 1) > MAX_CONTRASTS:
        raise ValueError("too many class pairs")
    return [
        Contrast(f"{a}-{b}", tuple(1 if c == a else -1 if c == b else 0 for c in classes), a)
        for a, b in permutations(classes, 2)
    ]


def estimate(profile: DataFrame, contrasts: list[Contrast]) -> DataFrame:
    """(contrast, main, logfc, unscaled) per feature: sum of coefficient x class mean, and the root of
    the sum of squared coefficients over class counts. Row-local: no join, no shuffle. Contrasts list the
    classes they use only, so a pair costs two terms however many classes there are."""
    rows = [
        {"contrast": k.name, "main": k.main, "used": [{"at": i, "k": v} for i, v in enumerate(k.coefs) if v]}
        for k in contrasts
    ]
    shape = "array<struct<contrast:string,main:string,used:array<struct<at:int,k:double>>>>"
    per = profile.select("*", F.inline(F.from_json(F.lit(json.dumps(rows)), shape)))

    def dot(term):
        return F.aggregate(
            "used", F.lit(0.0), lambda a, u: a + F.coalesce(term(F.get("c", u["at"]), u["k"]), F.lit(0.0))
        )

    logfc = dot(lambda e, k: k * e["mean"])
    unscaled = F.sqrt(dot(lambda e, k: F.try_divide(k * k, e["n"].cast("double"))))
    return per.select(
        *[c for c in profile.columns if c != "c"], "c", "contrast", "main", logfc.alias("logfc"), unscaled.alias("unscaled")
    )


@dataclass(frozen=True)
class VariancePrior:
    df: float
    s2: float
    df_pooled: float


def exact_median(values: DataFrame, column: str) -> float:
    """Median of a column without sorting it all: bracket it by approximate quantiles, then rank only
    the rows inside the bracket."""
    low, high = values.agg(F.percentile_approx(column, [0.49, 0.51], 10000).alias("q")).first()["q"]
    if low == high:
        return low
    col = F.col(column)
    n, below = values.agg(F.count(column), F.count_if(col < low)).first()
    wanted = sorted({(n - 1) // 2, n // 2})
    inside = values.where((col >= low) & (col <= high)).select(column).orderBy(column)
    rows = inside.offset(wanted[0] - below).limit(len(wanted)).collect()
    return sum(r[0] for r in rows) / len(rows)


def variance_prior(fitted: DataFrame) -> VariancePrior:
    """Scaled-F prior of the residual variances, by moments of their logs.

    fitted(feature, df, s2) is one row per feature; only a handful of sums reach the driver.
    """
    usable = fitted.where("df > 0 AND s2 IS NOT NULL").select("df", "s2")
    first = usable.agg(
        F.count("*").alias("n"), F.min("s2").alias("low"), F.sum("df").alias("pooled"),
        F.percentile_approx("s2", 0.51, 10000).alias("mid"),
    ).first()
    if first["n"] < 3:
        return VariancePrior(0.0, 0.0, float(first["pooled"] or 0))
    s2 = F.col("s2")
    if first["low"] < VARIANCE_FLOOR * first["mid"]:
        median = exact_median(usable, "s2") or 1.0
        s2 = F.greatest(s2, F.lit(VARIANCE_FLOOR * median))
    half = F.col("df") / 2.0
    e = F.log(s2) - digamma(half) + F.log(half)
    moments = usable.select(e.alias("e"), trigamma(half).alias("tri"), s2.alias("s2")).agg(
        F.avg("e").alias("mean"), F.var_samp("e").alias("var"), F.avg("tri").alias("tri"), F.avg("s2").alias("s2")
    ).first()
    extra = moments["var"] - moments["tri"]
    if extra <= 0:
        return VariancePrior(math.inf, moments["s2"], float(first["pooled"]))
    df0 = 2 * inverse_trigamma(extra)
    scale = math.exp(moments["mean"] + digamma_of(df0 / 2) - math.log(df0 / 2))
    return VariancePrior(df0, scale, float(first["pooled"]))


def moderated_test(estimates: DataFrame, prior: VariancePrior, lfc: float = TREAT_LFC) -> DataFrame:
    """Add s2_post, t and p of the test that |logfc| exceeds lfc, with variances shrunk to the prior."""
    df, s2 = F.col("df").cast("double"), F.coalesce("s2", F.lit(0.0))
    if math.isinf(prior.df):
        post = F.lit(prior.s2)
        df_total = F.lit(prior.df_pooled)
    else:
        post = F.try_divide(prior.df * prior.s2 + df * s2, prior.df + df)
        df_total = F.least(df + prior.df, F.lit(prior.df_pooled))
    shrunk = estimates.withColumn("s2_post", post).withColumn("df_total", df_total)
    se = F.col("unscaled") * F.sqrt("s2_post")
    over = F.try_divide(F.abs("logfc") - lfc, se)
    beyond = F.try_divide(F.abs("logfc") + lfc, se)
    return shrunk.withColumn("t", F.signum("logfc") * F.greatest(over, F.lit(0.0))).withColumn(
        "p", t_upper_tail(over, F.col("df_total")) + t_upper_tail(beyond, F.col("df_total"))
    )


def adjust_bh(tests: DataFrame, p: str = "p", by: str = "contrast") -> DataFrame:
    """Add adj_p: step-up adjusted p-values within each `by` group.

    Equal p-values are first folded to one row with a count, then laid out by range of (group, p). Ranks are
    counted inside each range and linked by a table with a row per range and group, so no task ever sorts
    a whole group.
    """
    tests = durable(tests)  # p must keep its very bits: it is a join key below
    known = tests.where(F.col(p).isNotNull())
    folded = known.groupBy(by, F.col(p).alias("_p")).agg(F.count("*").alias("_same"))
    ranged = durable(folded.repartitionByRange(by, "_p").withColumn("_range", F.spark_partition_id()))
    group = Window.partitionBy(by)
    along = group.orderBy("_range")
    inside = Window.partitionBy(by, "_range").orderBy("_p")
    sizes = ranged.groupBy(by, "_range").agg(F.sum("_same").alias("_size"))
    starts = sizes.select(
        by, "_range", (F.sum("_size").over(along) - F.col("_size")).alias("_start"), F.sum("_size").over(group).alias("_m")
    )
    rank = F.col("_start") + F.sum("_same").over(inside)
    raw = join_side(ranged, durable(starts), [by, "_range"]).withColumn("_raw", F.col("_p") * F.col("_m") / rank)
    # from the largest p down: a frame that only grows costs one step per row
    down = Window.partitionBy(by, "_range").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    local = durable(raw.select(by, "_range", "_p", F.min("_raw").over(down).alias("_low")))
    lows = local.groupBy(by, "_range").agg(F.min("_low").alias("_least"))
    later = group.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    after = lows.select(by, "_range", F.min("_least").over(later).alias("_after"))
    adjusted = join_side(local, durable(after), [by, "_range"]).select(
        by, "_p", F.least(F.col("_low"), F.coalesce("_after", F.lit(1.0)), F.lit(1.0)).alias("adj_p")
    )
    return join_side(tests.withColumn("_p", F.col(p)), durable(adjusted), [by, "_p"], "left").drop("_p")


def decide(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """Add decision: sign of logfc where adj_p is below the level, else 0."""
    hit = F.col("adj_p") < level
    return tests.withColumn("decision", F.when(hit, F.signum("logfc").cast("int")).otherwise(F.lit(0)))


def off_sex_and_mito_prefix(feature: str = "feature"):
    """True for features whose name does not start with a sex or mitochondrial chromosome."""
    return ~F.col(feature).rlike("|".join(f"^{name}" for name in SEX_AND_MITO))


def effects_table(data: Matrix | DataFrame, annotation: DataFrame, classes: list[str]) -> DataFrame:
    """Per feature and class: one-vs-rest estimate with class and others means; two classes keep only
    positive estimates. annotation(sample_id, class) chooses the samples."""
    return profile_effects(profile_matrix(data, annotation, classes), annotation, classes)


def profile_effects(profile: DataFrame, annotation: DataFrame, classes: list[str]) -> DataFrame:
    """effects_table from a complete profile with residuals."""
    table = class_effects(profile, classes, class_sizes(annotation))
    return table.where("logfc > 0") if len(classes) == 2 else table


def class_effects(profile: DataFrame, classes: list[str], sizes: dict[str, int]) -> DataFrame:
    """One row per feature and class: one-vs-rest estimate, class mean, mean of all other samples pooled, their
    absolute difference, and missing counts out of the class sizes."""
    estimates = estimate(profile, one_vs_rest(classes))
    main = F.get(F.filter("c", lambda e: e["class"] == F.col("main")), F.lit(0))
    n_all = F.aggregate("c", F.lit(0).cast("long"), lambda a, e: a + e["n"])
    total_all = F.aggregate("c", F.lit(0.0), lambda a, e: a + e["total"])
    size = F.element_at(F.create_map(*[F.lit(v) for c in classes for v in (c, sizes.get(c, 0))]), F.col("main"))
    everyone = sum(sizes.get(c, 0) for c in classes)
    wide = estimates.select("*", main.alias("m"), n_all.alias("n_all"), total_all.alias("total_all"))
    others_n = F.col("n_all") - F.col("m.n")
    others_mean = F.try_divide(F.col("total_all") - F.col("m.total"), others_n.cast("double"))
    return wide.select(
        F.col("main").alias("class"),
        "feature",
        "contrast",
        "logfc",
        "unscaled",
        "df",
        "s2",
        F.col("m.n").alias("n"),
        F.col("m.mean").alias("class_mean"),
        others_mean.alias("others_mean"),
        F.abs(F.col("m.mean") - others_mean).alias("class_diff"),
        (size - F.col("m.n")).alias("class_na"),
        (F.lit(everyone) - size - others_n).alias("others_na"),
    )


def top_markers(
    table: DataFrame, cutoff: float = MARKER_DIFF_CUTOFF, per_class: int = MARKERS_PER_CLASS
) -> DataFrame:
    """Per class, the features with the largest |logfc| among those with class_diff over the cutoff and
    off the sex and mitochondrial chromosomes; the feature name settles ties.

    Up to the session's group limit, Spark cuts every task's rows to per_class before the shuffle. Beyond
    it, the rows of a class are ranked by ranges, so that no task gets a whole class."""
    passing = table.where((F.abs("class_diff") > cutoff) & off_sex_and_mito_prefix())
    order = [F.desc(F.abs("logfc")), F.desc("logfc"), F.asc("feature")]
    cut = int(table.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if per_class > cut:
        return ranked(passing, "class", order).where(F.col("rank") <= per_class)
    window = Window.partitionBy("class").orderBy(*order)
    return passing.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= per_class)


def ranked(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """Add rank, 1 for the first row of each `by` group. Rows are laid out by range of (group, order) and
    numbered inside each range; a table with a row per range and group links the ranges."""
    ranged = durable(rows.repartitionByRange(F.col(by), *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(by, "_range").agg(F.count("*").alias("_size"))
    starts = sizes.select(by, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order))
    linked = join_side(ranged.withColumn("_inside", inside), durable(starts), [by, "_range"])
    return linked.withColumn("rank", (F.col("_start") + F.col("_inside")).cast("int")).drop("_start", "_inside", "_range")


def marker_counts(markers: DataFrame) -> DataFrame:
    return markers.groupBy("class").agg(F.count("*").alias("n_markers"))


def ranked_table(tests: DataFrame) -> DataFrame:
    """Add the rank of every test within its contrast: by p, then by falling logfc, then by feature."""
    return ranked(tests, "contrast", [F.asc("p"), F.desc("logfc"), F.asc("feature")])
