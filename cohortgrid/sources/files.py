"""Readers and writers of the file formats: wide CSV matrices, annotations, lists, prediction tables."""

from __future__ import annotations

import csv
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortgrid.cluster import task_count
from cohortgrid.fixed import MISSING_TEXT, MISSING_TEXTS_STRICT, SAMPLE_ID
from cohortgrid.matrix import Matrix, named_positions, number, quoted
from cohortgrid.operators.moments import matrix_moments
from cohortgrid.operators.quality import drop_features, feature_missingness

COLUMN_LIMIT = 2000
INFLATE_BYTES = 4 << 20  # of compressed text that a task inflates at once
PARSE_BYTES = 2 << 20  # of text that a task holds as fields at once


def _spread(df: DataFrame, path: str) -> DataFrame:
    """A compressed CSV is one split: spread its rows before working on them."""
    if path.lower().endswith(".gz"):
        return df.repartition(task_count(df.sparkSession))
    return df


def _upper_case(path: str) -> bool:
    """Whether the path ends in .gz, but not in lower case, by which Spark knows compressed files."""
    return path.lower().endswith(".gz") and not path.endswith(".gz")


def _header(spark: SparkSession, path: str) -> str:
    lines = _inflated(spark, path, 0) if _upper_case(path) else spark.read.text(path).withColumnRenamed("value", "line")
    return lines.first()["line"].lstrip("\ufeff")


def _inflated(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """line, from gzip files whatever their name, without the first `skip` lines of each; a file holds up to 2 GB
    compressed and is read by one task, piece by piece."""

    def lines(content: pa.Scalar) -> Iterator[list[bytes]]:
        data, at, rest, first = memoryview(content.as_buffer()), 0, b"", skip
        member = zlib.decompressobj(31)
        while at < len(data):
            out = member.decompress(data[at : at + INFLATE_BYTES])
            at = min(len(data), at + INFLATE_BYTES) - len(member.unused_data)
            if member.eof:
                member = zlib.decompressobj(31)
            *whole, rest = (rest + out).split(b"\n")
            yield whole[first:]
            first = max(0, first - len(whole))
        if rest and not first:
            yield [rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for part in lines(content):
                    texts = [x.decode().removesuffix("\r") for x in part]
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["line"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line STRING")


def read_matrix(spark: SparkSession, path: str, strict: bool = False, column_limit: int = COLUMN_LIMIT) -> Matrix:
    """Wide CSV: the first column is the key whatever its name, every other column is a feature.

    A path that ends in .gz, in any case, is read as gzip. Beyond column_limit names are kept as a table; rows are
    read alike.
    """
    if _upper_case(path):
        lines = _inflated(spark, path, 1)
    else:
        lines = spark.read.schema("line STRING").option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    return matrix_of_lines(_spread(lines, path), _header(spark, path), strict, column_limit)


def matrix_of_lines(
    lines: DataFrame, header: str, strict: bool = False, column_limit: int = COLUMN_LIMIT
) -> Matrix:
    """CSV text, one row of the matrix per row of lines(line).

    Names are taken from the header as they are. Lenient reading turns bad numbers to NULL, strict raises.
    Quoted fields may hold commas and doubled quotes, but no line breaks; a row with more or fewer fields than
    the header raises, and so does an open quote. Empty lines are skipped.
    """
    names = _fields(header)
    rows = lines.select("line").mapInArrow(_split_lines(len(names)), "sample_id STRING, fields ARRAY<STRING>")
    vectors = rows.select("sample_id", F.transform("fields", lambda v: number(v, strict)).alias("x"))
    if len(names) <= column_limit:
        return Matrix.from_vectors(vectors, names[1:])
    return Matrix(vectors, len(names) - 1, None, named_positions(lines.sparkSession, names[1:]))


def _fields(line: str) -> list[str]:
    return next(csv.reader([line], strict=True))


def _pieces(lines: pa.Array) -> Iterator[pa.Array]:
    """The lines in runs of about PARSE_BYTES, of one line at least; no text is copied."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(lines):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + PARSE_BYTES, "right")))
        yield lines.slice(at, upto - at)
        at = upto


def _split_lines(width: int):
    """Batches of lines to keys and the other fields as text; an empty field is null.

    A field is a Python object of several times its text, so the lines of a batch are parsed and sent in pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in (piece for batch in batches for piece in _pieces(batch.column(0))):
            keys, fields = [], []
            for row in map(_fields, filter(None, lines.to_pylist())):
                if len(row) != width:
                    raise ValueError(f"a row has {len(row)} fields, the header {width}: {row[:1]}")
                keys.append(row[0])
                fields.append([v or None for v in row[1:]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(fields, pa.list_(pa.string()))], ["sample_id", "fields"]
            )

    return run


def read_discovery_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of a wide CSV without the features that lack half or more of all samples in the file."""
    matrix = read_matrix(spark, path)
    return drop_features(matrix, feature_missingness(matrix_moments(matrix), matrix.vectors.count())).cells()


def read_annotation(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Annotation CSV with a header. Every column stays text, so that ids, split values and carried columns are
    what the file says. NA is NULL; strict takes every usual spelling of a missing value as NULL."""
    if not strict:
        return spark.read.csv(path, header=True, nullValue=MISSING_TEXT)
    df = spark.read.csv(path, header=True)
    return df.select(
        *[F.when(~F.col(quoted(c)).isin(*MISSING_TEXTS_STRICT), F.col(quoted(c))).alias(c) for c in df.columns]
    )


def read_feature_list(spark: SparkSession, path: str, stripped: bool = True) -> list[str]:
    """One name per line, in file order. Stripped: blanks around names and blank lines are dropped;
    otherwise lines are names as they are."""
    lines = spark.read.text(path)
    if stripped:
        lines = lines.select(F.trim("value").alias("value")).where(F.length("value") > 0)
    return [r["value"] for r in lines.collect()]


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Reference profiles: (feature, a ARRAY<DOUBLE> in tissue order) and the tissue names."""
    matrix = read_matrix(spark, path)
    return matrix.vectors.select(F.col("sample_id").alias("feature"), F.col("x").alias("a")), matrix.names()


def write_predictions(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV folder with a header; NA marks a missing value."""
    df.write.mode(mode).csv(path, header=True, nullValue=MISSING_TEXT)


def write_markers(markers: DataFrame, path: str, mode: str = "error") -> None:
    """One feature name per line."""
    markers.select("feature").write.mode(mode).text(path)


def write_fractions(fractions: DataFrame, path: str, mode: str = "error") -> None:
    """CSV of the wide table: sample_id, then the tissues in sorted order."""
    tissues = sorted(c for c in fractions.columns if c != SAMPLE_ID)
    write_predictions(fractions.select(SAMPLE_ID, *[F.col(quoted(t)) for t in tissues]), path, mode)
