"""The sample-by-feature matrix in its two forms: one vector per sample, or one row per cell."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortgrid.cluster import BROADCAST_BYTES, durable, fits_broadcast, join_side, require_present
from cohortgrid.fixed import MISSING_TEXTS_STRICT

RUN_FEATURES = 4096


@dataclass(frozen=True)
class Matrix:
    """vectors(sample_id, x ARRAY<DOUBLE>) and the features that name its positions 0..width-1.

    The names are a list when they are few enough for the driver, else a table(ord, feature).
    """

    vectors: DataFrame
    width: int
    listed: tuple[str, ...] | None = None
    table: DataFrame | None = None

    @staticmethod
    def from_vectors(vectors: DataFrame, names: list[str]) -> Matrix:
        return Matrix(vectors.select("sample_id", "x"), len(names), tuple(names))

    @staticmethod
    def from_wide(df: DataFrame, key: str, strict: bool = False) -> Matrix:
        """One column per feature -> one array per row; no shuffle. Text that is no number becomes NULL
        (or raises, if strict)."""
        names = [c for c in df.columns if c != key]
        cells = [number(F.col(quoted(c)).cast("string"), strict) for c in names]
        return Matrix.from_vectors(df.select(F.col(quoted(key)).cast("string").alias("sample_id"), F.array(*cells).alias("x")), names)

    @staticmethod
    def from_cells(cells: DataFrame, names: list[str] | None = None) -> Matrix:
        """cells(sample_id, feature, value) -> vectors over the given features (default: all, by name).

        Cells are first made unique per (sample, position), which also combines repeats before the
        shuffle, so the list gathered per sample never exceeds the matrix width. Absent cells are NULL; a
        cell given twice raises. A sample that has none of the features keeps a row.
        """
        if names is None:
            shape = _numbered(durable(cells.select("feature").distinct()))
        else:
            shape = Matrix(cells, len(names), tuple(names))
        width = shape.width
        placed = shape._with_names(cells, "feature", "left").groupBy("sample_id", "ord").agg(
            F.max("value").alias("value"), F.count("ord").alias("copies")
        )
        repeated = F.raise_error(F.concat(F.lit("repeated cell of sample "), "sample_id")).cast("double")
        once = placed.select("sample_id", "ord", F.when(F.col("copies") <= 1, F.col("value")).otherwise(repeated).alias("value"))
        packed = once.groupBy("sample_id").agg(
            F.collect_list(F.when(F.col("ord").isNotNull(), F.struct("ord", "value"))).alias("p")
        )
        every = F.sequence(F.lit(0), F.lit(width - 1)) if width else F.array().cast("array<int>")
        absent = F.transform(
            F.array_except(every, F.col("p.ord")),
            lambda i: F.struct(i.alias("ord"), F.lit(None).cast("double").alias("value")),
        )
        filled = F.when(F.size("p") == width, F.col("p")).otherwise(F.concat("p", absent))
        vectors = packed.select("sample_id", F.sort_array(filled)["value"].alias("x"))
        return Matrix(vectors, width, shape.listed, shape.table)

    def written(self) -> Matrix:
        """The same matrix, computed once and written: for vectors that several jobs will read."""
        return Matrix(durable(self.vectors), self.width, self.listed, self.table)

    @property
    def features(self) -> DataFrame:
        """(ord, feature)"""
        if self.table is not None:
            return self.table.select("ord", "feature")
        return named_positions(self.vectors.sparkSession, self.listed)

    def names(self) -> list[str]:
        if self.listed is not None:
            return list(self.listed)
        return [r["feature"] for r in self.features.orderBy("ord").collect()]

    def _with_names(self, df: DataFrame, on: str, how: str = "inner") -> DataFrame:
        if self.listed is not None and sum(map(len, self.listed)) * 4 + 8 * self.width <= BROADCAST_BYTES:
            return df.join(F.broadcast(self.features), on, how)
        return join_side(df, self.features, on, how)

    def positions_of(self, df: DataFrame) -> DataFrame:
        """Add the position ord to rows with a feature; rows of features that the matrix lacks go."""
        return self._with_names(df, "feature")

    def named(self, df: DataFrame) -> DataFrame:
        """Replace column ord by the feature name."""
        return self._with_names(df, "ord").select("feature", *[F.col(quoted(c)) for c in df.columns if c != "ord"])

    def positions(self, samples: DataFrame | None = None, together: bool = True) -> DataFrame:
        """One row per cell, keyed by position: (sample_id, ord, value), with the columns of samples.

        Samples are joined before the vectors are unfolded. Statistics per feature run on positions, whose
        features stand together (see unfolded); the names are joined to their results, which are one row
        per feature. With together=False cells stay with their sample.
        """
        vectors = self.vectors if samples is None else join_side(self.vectors, samples, "sample_id")
        return unfolded(vectors, "x", self.width, together)

    def cells(self, samples: DataFrame | None = None) -> DataFrame:
        """One row per cell: (sample_id, feature, value), with the columns of samples."""
        unfolded = self._with_names(self.positions(samples, together=False), "ord")
        first = ["sample_id", "feature", "value"]
        return unfolded.select(*first, *[F.col(quoted(c)) for c in unfolded.columns if c not in (*first, "ord")])

    def project(self, wanted: list[str]) -> Matrix:
        """Keep the listed features in the listed order; an unknown name raises."""
        if self.listed is not None:
            place = {name: i for i, name in enumerate(self.listed)}
            missing = [name for name in wanted if name not in place]
            if missing:
                raise ValueError(f"{len(missing)} selected features not in the data, e.g. {missing[:5]}")
            take = [place[name] for name in wanted]
        else:
            order = named_positions(self.vectors.sparkSession, wanted).withColumnRenamed("ord", "at")
            require_present(order, self.features, "feature", "selected features")
            take = [r["ord"] for r in join_side(self.features, order, "feature").orderBy("at").select("ord").collect()]
        places = F.from_json(F.lit(json.dumps(take)), "array<int>")
        return Matrix.from_vectors(
            self.vectors.select("sample_id", F.transform(places, lambda i: F.get("x", i)).alias("x")), wanted
        )


def unfolded(vectors: DataFrame, column: str, width: int, together: bool = True) -> DataFrame:
    """Replace an array column by (ord, value), one row per entry, the entries of a feature together.

    A task holds few wide vectors, so sums per feature would combine next to nothing before their shuffle.
    Wide vectors are therefore cut into runs of features first, and the runs travel as packed arrays to the
    task of their features; a run that fills more than one task is split by adaptive execution. Vectors of
    one run stay where they are: every task combines all its rows per feature.
    """
    kept = [F.col(quoted(c)) for c in vectors.columns if c != column]
    if width <= RUN_FEATURES or not together:
        return vectors.select(*kept, F.posexplode(column).alias("ord", "value"))
    cut = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1), F.lit(RUN_FEATURES)),
        lambda start: F.struct(start.alias("_start"), F.slice(column, start + 1, RUN_FEATURES).alias("_part")),
    )
    runs = vectors.select(*kept, F.inline(cut)).hint("rebalance", "_start")
    placed = runs.select(*kept, "_start", F.posexplode("_part").alias("_at", "value"))
    return placed.select(*kept, (F.col("_start") + F.col("_at")).alias("ord"), "value")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number(col: Column, strict: bool = False) -> Column:
    """Text to double: NULL for bad text, or an error if strict; a spelled-out missing value is NULL."""
    # Java also reads "1d" and "1f" as numbers; here they are text
    suffixed = F.lower(F.right(F.rtrim(col), F.lit(1))).isin("d", "f") & ~F.lower(col).contains("inf")
    if strict:
        refused = F.raise_error(F.concat(F.lit("not a number: "), col)).cast("double")
        value = F.when(~F.trim(col).isin(*MISSING_TEXTS_STRICT), F.when(suffixed, refused).otherwise(col.cast("double")))
    else:
        value = F.when(~suffixed, col).try_cast("double")
    return F.when(~F.isnan(value), value)


def named_positions(spark: SparkSession, names) -> DataFrame:
    table = pa.table(
        {"ord": pa.array(range(len(names)), pa.int32()), "feature": pa.array(list(names), pa.string())}
    )
    return spark.createDataFrame(table)


def _numbered(names: DataFrame) -> Matrix:
    """Give distinct names the positions 0..n-1 in sorted order.

    Few names are sorted on the driver. Else the sort is a distributed range sort, and zipWithIndex then
    only needs the partition sizes.
    """
    if fits_broadcast(names):
        listed = sorted(r["feature"] for r in names.collect())
        return Matrix(names, len(listed), tuple(listed))
    pairs = names.orderBy("feature").rdd.zipWithIndex().map(lambda r: (r[1], r[0][0]))
    table = durable(names.sparkSession.createDataFrame(pairs, "ord INT, feature STRING"))
    return Matrix(names, table.count(), None, table)
