"""File formats in and out."""

import gzip

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from cohortgrid.operators import mixture
from cohortgrid.sources import files

WIDE = 'sample,"f.1",F.1,chr1:2\n"s1",1.5,NA,3\ns2,,bad,1e2\ns3,4,5,NaN\n'


@pytest.fixture()
def wide(tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(WIDE)
    return str(path)


def rows_of(matrix):
    return {r["sample_id"]: r["x"] for r in matrix.vectors.collect()}


WANT = {"s1": [1.5, None, 3.0], "s2": [None, None, 100.0], "s3": [4.0, 5.0, None]}


def test_matrix_keeps_raw_names(spark, wide):
    matrix = files.read_matrix(spark, wide)
    assert matrix.names() == ["f.1", "F.1", "chr1:2"] and rows_of(matrix) == WANT


def test_line_route_reads_the_same(spark, wide):
    matrix = files.read_matrix(spark, wide, column_limit=2)
    assert matrix.names() == ["f.1", "F.1", "chr1:2"] and rows_of(matrix) == WANT
    assert {tuple(r) for r in matrix.cells().where("feature = 'f.1'").collect()} == {("s1", "f.1", 1.5), ("s2", "f.1", None), ("s3", "f.1", 4.0)}
    assert rows_of(matrix.project(["chr1:2", "f.1"]))["s1"] == [3.0, 1.5]


@pytest.mark.parametrize("limit", [2, 2000])
def test_gzip(spark, tmp_path, limit):
    path = tmp_path / "m.csv.gz"
    path.write_bytes(gzip.compress(WIDE.encode()))
    assert rows_of(files.read_matrix(spark, str(path), column_limit=limit)) == WANT


def test_strict_numbers(spark, wide, tmp_path):
    with pytest.raises(PySparkException):
        files.read_matrix(spark, wide, strict=True).vectors.collect()
    good = tmp_path / "g.csv"
    good.write_text("id,a\ns,1\nt,NA\n")
    assert rows_of(files.read_matrix(spark, str(good), strict=True)) == {"s": [1.0], "t": [None]}


def test_discovery_cells_drop_half_missing(spark, wide):
    cells = files.read_discovery_cells(spark, wide)
    assert {r["feature"] for r in cells.collect()} == {"f.1", "chr1:2"}


def test_annotation(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("sample_id,age,train_or_test\ns1,40,1\ns2,NA,0\ns3,50,nan\n")
    text = files.read_annotation(spark, str(path))
    assert [tuple(r) for r in text.collect()] == [("s1", "40", "1"), ("s2", None, "0"), ("s3", "50", "nan")]
    strict = files.read_annotation(spark, str(path), strict=True)
    assert [tuple(r) for r in strict.collect()] == [("s1", "40", "1"), ("s2", None, "0"), ("s3", "50", None)]
    path.write_text("sample_id,is_test,dose\n001,TRUE,1.50\n")
    assert tuple(files.read_annotation(spark, str(path)).first()) == ("001", "TRUE", "1.50")


def test_open_quote_raises(spark, tmp_path):
    path = tmp_path / "open.csv"
    path.write_text('id,a\n"s1,1\ns2,2\n')
    with pytest.raises(Exception, match="unexpected end of data"):
        files.read_matrix(spark, str(path)).vectors.collect()


def test_feature_lists(spark, tmp_path):
    path = tmp_path / "f.txt"
    path.write_text(" f2 \n\nf1\n")
    assert files.read_feature_list(spark, str(path)) == ["f2", "f1"]
    assert files.read_feature_list(spark, str(path), stripped=False) == [" f2 ", "", "f1"]


def test_profiles_and_fractions(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("marker_id,t10,t2\nm1,1,0\nm2,0,1\n")
    profiles, tissues = files.read_profiles(spark, str(path))
    assert tissues == ["t10", "t2"]
    cells = spark.createDataFrame([("s", "m1", 0.25), ("s", "m2", 0.75)], "sample_id STRING, feature STRING, value DOUBLE")
    out = str(tmp_path / "out")
    files.write_fractions(mixture.deconvolve(cells, profiles, tissues), out)
    assert spark.read.text(out).collect()[0][0] == "sample_id,t10,t2"
    assert spark.read.csv(out, header=True, inferSchema=True).first()[1:] == (pytest.approx(0.25), pytest.approx(0.75))


def test_prediction_and_marker_files(spark, tmp_path):
    df = spark.createDataFrame([("s1", 0.1, "x"), ("s2", None, None)], "sample_id STRING, score DOUBLE, label STRING")
    files.write_predictions(df.coalesce(1), str(tmp_path / "p"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "p")).collect()] == ["sample_id,score,label", "s1,0.1,x", "s2,NA,NA"]
    markers = spark.createDataFrame([("f1", 1), ("f2", 2)], "feature STRING, n INT")
    files.write_markers(markers, str(tmp_path / "m"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "m")).collect()) == ["f1", "f2"]
    with pytest.raises(PySparkException):
        files.write_markers(markers, str(tmp_path / "m"))


@pytest.mark.parametrize("column_limit", [1, 2000])
def test_one_parser_for_every_width(spark, tmp_path, column_limit):
    path = tmp_path / "quoted.csv"
    path.write_text('id,"a,b",c\r\n"s,2","1.5",2\r\ns1,,"3"\r\n')
    matrix = files.read_matrix(spark, str(path), column_limit=column_limit)
    assert {r["sample_id"]: r["x"] for r in matrix.vectors.collect()} == {"s,2": [1.5, 2.0], "s1": [None, 3.0]}
    assert matrix.names() == ["a,b", "c"]
    path.write_text("id,a,b\ns1,1\n")
    with pytest.raises(Exception, match="fields"):
        files.read_matrix(spark, str(path), column_limit=column_limit).vectors.collect()
    path.write_text("id,a\ns1,1d\n")
    with pytest.raises(Exception, match="not a number"):
        files.read_matrix(spark, str(path), strict=True, column_limit=column_limit).vectors.collect()


def test_lines_of_a_batch_are_parsed_in_bounded_pieces():
    """A batch of 12 MB, an empty line and a null among its lines, and one line longer than a piece."""
    width = 2001
    lines = [f"s{i}," + ",".join(["0.5"] * (width - 1)) for i in range(1500)]
    long = '"long"' + ",0.25".ljust(1600, "0") * (width - 1)
    batch = pa.record_batch([pa.array([*lines[:700], "", None, long, *lines[700:]], pa.string())], ["line"])
    parsed = list(files._split_lines(width)(iter([batch, batch.slice(0, 0)])))
    assert [k for b in parsed for k in b.column("sample_id").to_pylist()] == [f"s{i}" for i in range(700)] + ["long"] + [f"s{i}" for i in range(700, 1500)]
    assert all(len(x) == width - 1 for b in parsed for x in b.column("fields"))
    text = [sum(len(v.as_py()) + 1 for v in b.column("fields").values) for b in parsed if b.num_rows > 1]
    assert max(text) <= 2 << 20 < sum(text)
