"""The pipeline's stages on odd rows, and on a few texts against plain Python; keys, tiles and contexts."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cohortgrid.llm import pii
from cohortgrid.llm.common import text_key
from cohortgrid.llm.jaccard_join import set_key, small_size, tile_keys
from cohortgrid.llm.toxicity import bands, one_of_kind

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _odd string, _d1 string, d1 long, label int"
PASSAGE = " ".join(f"bench{i}" for i in range(14))


def text(seed, words=40):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randint(0, 400)}" for _ in range(words))


def rows():
    a, b, c = text(1, 80), text(2), text(3)
    near = a.replace(a.split()[20], "other", 1)
    plain = [
        (5, a), (9, near), (7, b), (8, text(4) + " " + PASSAGE), (11, "mail jo@example.org now " + c),
        (None, a), (None, text(4) + " " + PASSAGE), (None, None), (12, None), (13, ""), (13, ""), (14, text(5)), (14, text(6)),
        (14, PASSAGE), (15, text(7, 30_000)), (15, text(7, 30_000)), (16, text(8)), (16, text(8)), (17, text(8)),
    ]
    return [(*r, "en", "s", 3, "x", "y", 5, 1) for r in plain]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def texts_of(frame):
    return Counter((r["doc_id"], r["text"]) for r in frame.collect())


def test_toxicity_without_labels_keeps_or_drops_all(spark, docs, folder):
    assert corpus_pipeline.toxicity(spark, docs, folder).columns == docs.columns


def test_toxicity_judges_rows(spark, docs, folder, monkeypatch):
    class Model:
        def scorer(self):
            return lambda t: float("bench3" in t)

    monkeypatch.setattr(corpus_pipeline, "fit_toxicity", lambda *a: Model())
    got = corpus_pipeline.toxicity(spark, docs, folder)
    assert texts_of(got) == Counter((r[0], r[1]) for r in rows() if "bench3" not in (r[1] or ""))


def test_near_duplicates_judge_rows(spark, docs, folder):
    got = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert got.columns == docs.columns
    left = Counter((r[0], r[1]) for r in rows())
    for gone in [(9, rows()[1][1]), (None, text(1, 80)), (None, text(4) + " " + PASSAGE), (15, text(7, 30_000)), (16, text(8)), (16, text(8))]:
        left[gone] -= 1
    assert texts_of(got) == +left


def test_decontamination_judges_rows(spark, docs, folder):
    got = corpus_pipeline.decontamination(spark, docs, folder)
    assert got.columns == docs.columns
    assert texts_of(got) == Counter((r[0], r[1]) for r in rows() if "bench3" not in (r[1] or ""))


def test_pii_and_tokens_keep_rows(spark, docs, folder):
    got = corpus_pipeline.pii(spark, docs, folder)
    assert texts_of(got) == Counter((r[0], r[1] and r[1].replace("jo@example.org", "<EMAIL>")) for r in rows())
    assert corpus_pipeline.tokens(spark, docs, folder).count() == len(rows())


def test_stages_of_nothing(spark, docs, folder):
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).isEmpty()


def test_the_whole_run_equals_plain_python(spark, folder, tmp_path, monkeypatch):
    """200 texts, with a classifier that looks for one word; every other stage by its own code."""

    class Model:
        def scorer(self):
            return lambda t: float("vile" in t.split())

    monkeypatch.setattr(corpus_pipeline, "fit_toxicity", lambda *a: Model())
    rng = random.Random(9)
    table = []
    for i in range(200):
        words = text(i // 3 * 10 if i % 3 == 1 else i, rng.choice([3, 12, 60])).split()
        if i % 7 == 0:
            words.insert(1, "vile")
        if i % 11 == 0:
            words[2:2] = PASSAGE.split()[:10]
        if i % 5 == 0:
            words.append("jo.doe@example.org")
        table.append((i, " ".join(words)))
    where = str(tmp_path)
    spark.createDataFrame(table, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{where}/labels.parquet")

    left = [(i, t) for i, t in table if "vile" not in t.split()]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in left)}
    first = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]):
                a, b = first[i], first[j]
                first = {k: min(a, b) if v in (a, b) else v for k, v in first.items()}
    left = [(i, t) for i, t in left if first[i] == i]
    windows = {tuple(PASSAGE.split()[k : k + 10]) for k in range(5)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    left = [(i, t) for i, t in left if not any(tuple(words(t)[k : k + 10]) in windows for k in range(len(words(t))))]
    left = {i: t.replace("jo.doe@example.org", "<EMAIL>") for i, t in left}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in left.items()}
    got = corpus_pipeline.run(spark, where).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got} == want and 20 < len(want) < 180


def test_the_parts_of_a_text_key_are_independent(spark):
    texts = [text(i) for i in range(200)] + ["", "a"]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    got = table.select(text_key(F.col("text"))["d1"].alias("d1"), text_key(F.col("text"))["d2"].alias("d2")).collect()
    assert len({r["d1"] for r in got}) == len({r["d2"] for r in got}) == len(texts)
    for r in got:  # a salt behind the text would make d2 a hash of the salt that starts from d1
        for salt in (1).to_bytes(4, "little"), (1).to_bytes(8, "little"):
            seeded = xxhash.xxh64_intdigest(salt, seed=r["d1"] & (1 << 64) - 1)
            assert seeded != r["d2"] & (1 << 64) - 1


def test_small_sets_share_no_crowded_tile():
    rng = np.random.default_rng(0)
    for size in (3, 4, 6, 9, 12, 16, 20):
        counts = Counter()
        for _ in range(2000):
            counts.update(tile_keys(np.unique(rng.integers(0, (1 << 64) - 1, size, np.uint64)), 80, 100).tolist())
        assert max(counts.values()) <= 4, size


@pytest.mark.parametrize("num,den", [(80, 100), (90, 100), (60, 100), (95, 100)])
def test_linked_sets_share_a_tile(num, den):
    rng = np.random.default_rng(num)
    assert small_size(num, den) > 0
    for _ in range(3000):
        size = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, (1 << 64) - 1, size, np.uint64))
        b = a[rng.random(len(a)) > rng.choice([0.02, 0.1, 0.2])]
        b = np.unique(np.concatenate([b, rng.integers(0, (1 << 64) - 1, int(rng.integers(0, 4)), np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and den * both >= num * (len(a) + len(b) - both) and set_key(a) != set_key(b):
            assert len(np.intersect1d(tile_keys(a, num, den), tile_keys(b, num, den)))


def test_long_local_parts_and_words_take_linear_time():
    began = time.time()
    spans = pii.base_spans("a" * 1_000_000 + "@ " + "b" * 1000 + "@x.org")
    assert spans == [(1_000_002, 0, 1_001_008)] and time.time() - began < 20


def test_contexts_take_whole_words():
    long = "w" * 200
    told = f"call {long} 555-0199 {'v' * 90} x"
    at = told.index("555")
    found = pii.Words(told).contexts(at, at + 8)
    other = pii.Words(told.replace("w" * 200, "w" * 199 + "u")).contexts(at, at + 8)
    assert len(found) == 2 and found[0] != other[0] and found[1] != other[1] and max(map(len, found)) < 200


def test_only_near_copies_leave_the_sample(spark):
    base = [f"w{i}" for i in range(40)]
    sets = [(0, 1, base), (1, 1, base[:-1] + ["x"]), (2, 0, base), (3, 1, base[:5] + [f"v{i}" for i in range(35)]), (4, 1, []), (5, 1, [])]
    table = spark.createDataFrame([(i, y, w, bands(w)) for i, y, w in sets], "doc_id long, label int, words array<string>, bands array<long>")
    assert sorted(r["doc_id"] for r in one_of_kind(table).collect()) == [0, 2, 3, 4, 5]


