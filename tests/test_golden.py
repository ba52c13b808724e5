"""Whole studies against golden predictions: scores within 1e-4, labels equal."""

import csv

import pytest

from cohortgrid.plans import studies
from cohortgrid.sources.files import read_annotation, read_feature_list, read_matrix

SPLIT = "train_or_test:test"
CASES = {
    "detection": "input/*detection",
    "surveillance": "input/*surveillance",
    "typing": "input/*typing",
    "disease": "input/*disease*",
    "race": "input/*race*",
}


def run(spark, golden, study):
    files = CASES[study]
    samples = read_annotation(spark, golden(files + "_sample.csv"), strict=study == "disease")
    matrix = read_matrix(spark, golden(files + "_data.csv"), strict=study == "disease")
    extra = []
    if study in ("disease", "race"):
        extra = [read_feature_list(spark, golden(files + "_feature.txt"))]
    return getattr(studies, study)(samples, matrix, SPLIT, *extra)


@pytest.mark.parametrize("study", CASES)
def test_study_matches_golden(spark, golden, study):
    with open(golden(f"output/*{study}*.reference")) as f:
        want = list(csv.DictReader(f))
    got = run(spark, golden, study)
    assert got.columns == list(want[0])
    key = "sample_id"
    rows = {r[key]: r.asDict() for r in got.collect()}
    assert len(rows) == len(want)
    for line in want:
        mine = rows[line[key]]
        for name, text in line.items():
            if isinstance(mine[name], float):
                tolerance = 1e-4 * (max(1.0, float(text)) if name == "ratio" else 1.0)
                assert mine[name] == pytest.approx(float(text), abs=tolerance), (line[key], name)
            else:
                assert str(mine[name]) == text
