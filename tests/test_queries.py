"""Every query against its SQL, on the small driver tables."""

import os

import pytest

import __spark_entry__ as contract
from catalog.oracles import ORACLES
from catalog.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SCORE_NAMES = {"deconv_posterior"}  # no closed SQL form


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, (str, bool)):
        return str(value)
    return repr(float(value) + 0.0)


def test_every_query_but_the_listed_has_sql():
    assert set(QUERIES) - set(ORACLES) == SCORE_NAMES
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    mine = sorted(tuple(map(plain, row)) for row in frame.select(*[f"`{c}`" for c in columns]).collect())
    answer = duck.execute(ORACLES[name])
    order = [[d[0] for d in answer.description].index(c) for c in columns]
    assert len(order) == len(answer.description)
    theirs = sorted(tuple(plain(row[i]) for i in order) for row in answer.fetchall())
    assert mine == theirs
    assert mine


@pytest.mark.parametrize("name", sorted(SCORE_NAMES))
def test_other_queries_return_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns[0] == "sample_id" and frame.columns[-2:] == ["ratio", "pred_label"]
    assert frame.count() > 0


def supplier_tables(path, first, left_out=(), put=()):
    """lineitem and part with a line for each of 8 suppliers from `first`, both statuses and 25 brands."""
    pa, pq = pytest.importorskip("pyarrow"), pytest.importorskip("pyarrow.parquet")
    value = {(s, t, b): ((s * 7 + b * 3 + (t == "O") * b) % 11) / 100 for s in range(8) for t in "OF" for b in range(25)}
    value = {k: v for k, v in value.items() if k not in left_out} | dict(put)
    keys = list(value)
    path.mkdir()
    pq.write_table(
        pa.table({
            "l_partkey": [b for _, _, b in keys], "l_suppkey": [first + s for s, _, _ in keys],
            "l_linestatus": [t for _, t, _ in keys], "l_discount": list(value.values()),
        }),
        path / "lineitem.parquet",
    )
    pq.write_table(pa.table({"p_partkey": list(range(25)), "p_brand": [f"Brand#{b + 11}" for b in range(25)]}), path / "part.parquet")
    return value


def surveyed(spark, path, first):
    rows = QUERIES["study_surveillance"](spark, str(path)).collect()
    return {(int(r["sample_id"][1:].split("_")[0]) - first, r["cancer_status"]): r["pred.score_liver.cancer"] for r in rows}


@pytest.mark.parametrize("first", [6_000_000_000, -4])
def test_surveillance_takes_any_supplier_key(spark, tmp_path, first):
    """Keys beyond 32 bits, and below 0; odd keys below 0 are tested, as in the SQL."""
    duckdb = pytest.importorskip("duckdb")
    supplier_tables(tmp_path / "t", first)
    mine = surveyed(spark, tmp_path / "t", first)
    connection = duckdb.connect()
    for name in ("lineitem", "part"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/t/{name}.parquet'")
    answer = connection.execute(ORACLES["study_surveillance"])
    at = [d[0] for d in answer.description].index("pred.score_liver.cancer")
    theirs = {(int(r[0][1:].split("_")[0]) - first, r[1]): r[at] for r in answer.fetchall()}
    assert mine.keys() == theirs.keys() and mine == pytest.approx(theirs, abs=2e-4)


def test_surveillance_fills_missing_cells(spark, tmp_path):
    """A cell that training and test samples lack scores as if it held the mean of the training samples."""
    gaps = [(1, "O", 3), (2, "F", 3), (4, "O", 20)]
    value = supplier_tables(tmp_path / "gaps", 0, gaps)
    known = {b: [v for (s, _, c), v in value.items() if s % 2 and c == b] for b in (3, 20)}
    put = {k: sum(known[k[2]]) / len(known[k[2]]) for k in gaps}
    supplier_tables(tmp_path / "whole", 0, put=put)
    scored = surveyed(spark, tmp_path / "gaps", 0)
    assert len(scored) == 8 and scored == pytest.approx(surveyed(spark, tmp_path / "whole", 0), abs=2e-4)
