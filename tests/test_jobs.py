"""Jobs from files to files."""

import random

import pytest

from cohortgrid.plans import jobs


def write_csv(path, header, rows):
    path.write_text("\n".join([",".join(header), *[",".join(map(str, r)) for r in rows]]) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def cohort(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cohort")
    rng = random.Random(1)
    notes, cells = [], []
    for i in range(60):
        kind = "abc"[i % 3]
        notes.append((i, "cancer" if i % 2 else "normal", kind, kind, "test" if i % 5 == 0 else "train"))
        cells.append((i, *[round(rng.gauss(2.0 if "abc".index(kind) == j else 0.0, 0.4), 4) for j in range(3)], "NA"))
    samples = write_csv(folder / "s.csv", ["sample_id", "cancer_status", "disease_type", "race", "part"], notes)
    matrix = write_csv(folder / "m.csv", ["sample", "f1", "f2", "chrY:f3", "gone"], cells)
    return samples, matrix


def lines(spark, path):
    return sorted(r[0] for r in spark.read.text(str(path)).collect())


def test_plasma_markers(spark, cohort, tmp_path):
    samples, matrix = cohort
    jobs.discover_plasma_markers(spark, "liver.disease.study", samples, matrix, str(tmp_path / "d"), "part:test", 0.5, 2)
    assert lines(spark, tmp_path / "d") == ["f1", "f2"]
    (tmp_path / "u.txt").write_text("f2\n")
    jobs.discover_plasma_markers(
        spark, "race.study", samples, matrix, str(tmp_path / "r"), "part:test", 0.5, 2, str(tmp_path / "u.txt")
    )
    assert lines(spark, tmp_path / "r") == ["f1"]


def test_race_and_disease_files(spark, cohort, tmp_path):
    samples, matrix = cohort
    (tmp_path / "f.txt").write_text("f1\nf2\nchrY:f3\n")
    jobs.predict_race(spark, samples, "part:test", matrix, str(tmp_path / "f.txt"), str(tmp_path / "race"))
    race = spark.read.csv(str(tmp_path / "race"), header=True)
    assert race.columns[-5:] == ["a", "b", "c", "ratio", "pred.label"] and race.count() == 12
    jobs.predict_disease(
        spark, samples, "sample_id", "disease_type", "part:TEST", matrix, str(tmp_path / "f.txt"), str(tmp_path / "dis"), "svd2"
    )
    rows = spark.read.csv(str(tmp_path / "dis"), header=True).collect()
    assert len(rows) == 12 and sum(r["true_label"] == r["pred_label"] for r in rows) >= 11


def test_detection_refuses_missing_values(spark, cohort, tmp_path):
    samples, matrix = cohort
    with pytest.raises(Exception, match="must not have missing values"):
        jobs.detect(spark, samples, "part:test", matrix, str(tmp_path / "out"))


def test_tissue_markers(spark, tmp_path):
    sides = [(i, side) for i in range(4) for side in ("tumor", "normal.tissue")]
    rows = [(f"p{i}_{side}", *[1.0 if side == "tumor" else 0.0] * 2, 0.5) for i, side in sides]
    rows += [(f"extra{i}", 0.0, "NA", 0.5) for i in range(9)]  # half of the file lacks the second feature
    matrix = write_csv(tmp_path / "m.csv", ["id", "up", "sparse", "flat"], rows)
    samples = write_csv(tmp_path / "s.csv", ["sample_id", "cancer_type"], [(f"p{i}_tumor", "liver_cancer") for i in range(4)])
    jobs.discover_tissue_markers(spark, "liver.cancer.study", samples, matrix, str(tmp_path / "out"), 0.2, 5)
    assert lines(spark, tmp_path / "out") == ["up"]


def test_fractions(spark, tmp_path):
    profiles = write_csv(tmp_path / "p.csv", ["marker_id", "t2", "t1"], [(f"m{i}", i, 10 - i) for i in range(11)])
    header = ["sample_id", *[f"m{i}" for i in range(11)]]
    samples = [("x", *[0.3 * i + 0.7 * (10 - i) for i in range(11)]), ("y", *range(11))]
    matrix = write_csv(tmp_path / "m.csv", header, samples)
    jobs.deconvolve(spark, profiles, matrix, str(tmp_path / "out"), estimate="constrained_ls")
    got = {r[0]: r[1:] for r in spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True).select("sample_id", "t1", "t2").collect()}
    assert got["x"] == (pytest.approx(0.7), pytest.approx(0.3)) and got["y"] == (pytest.approx(0), pytest.approx(1))


def test_gzip_in_any_case(spark, tmp_path, monkeypatch):
    """Also of several members, read in small pieces, with line ends of either kind."""
    import gzip

    import cohortgrid.sources.files as files

    text = ["sample_id,a,b", *[f"s{i},{i},{i}.5" for i in range(500)], "last,NA,7"]
    content = "\n".join(text[:200]) + "\n" + "\r\n".join(text[200:])
    parts = [content[:37], content[37:900], content[900:]]
    packed = b"".join(gzip.compress(p.encode()) for p in parts)
    want = sorted((f"s{i}", (float(i), i + 0.5)) for i in range(500)) + [("last", (None, 7.0))]
    for name, size in (("m.csv.GZ", 4 << 20), ("n.csv.Gz", 50), ("o.csv.gz", 4 << 20)):
        (tmp_path / name).write_bytes(packed)
        monkeypatch.setattr(files, "INFLATE_BYTES", size)
        matrix = files.read_matrix(spark, str(tmp_path / name))
        assert matrix.names() == ["a", "b"]
        assert sorted(((r["sample_id"], tuple(r["x"])) for r in matrix.vectors.collect()), key=str) == sorted(want, key=str)
