"""Operators on text against brute force, and on nulls, empty and long texts, repeated rows, empty tables, odd columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortgrid.llm import bpe, pii
from cohortgrid.llm.decontamination import contaminated
from cohortgrid.llm.fingerprints import compared_with_edits
from cohortgrid.llm.graph import components
from cohortgrid.llm.jaccard_join import similar_components
from cohortgrid.llm.labelled import clean_labels
from cohortgrid.llm.quality import fit_quality, quality_scores
from cohortgrid.llm.queries import LLM_ORACLES, LLM_QUERIES, VOCABULARY
from cohortgrid.llm.substring_dedup import without_repeats
from cohortgrid.llm.toxicity import fit_toxicity, toxicity_scores
from cohortgrid.llm.url_filters import judge_urls

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d1 long, word string, key long"


def odd_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "É", "ñu"]
    long = " ".join(rng.choice(words) for _ in range(6000))
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(25)]
    texts = [None, "", "   \n\t", "one", "One", "é", long, long + " tail", *base, *[t + " more" for t in base[:8]], base[0], base[0]]
    rows = [(i, t, "en", None, 1, 7, "x", None) for i, t in enumerate(texts)]
    return [*rows, rows[9], (None, base[1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("ngram,num", [(3, 90), (5, 80), (2, 60)])
def test_components_equal_brute_force(odd, ngram, num):
    sets, parent = [], {}
    for doc_id, text, *_ in odd_rows():
        words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        sets.append((doc_id, {tuple(words[i : i + ngram]) for i in range(max(1, len(words) - ngram + 1))} if words else set()))
        parent[doc_id] = doc_id

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and a is not None and b is not None and 100 * len(s & t) >= num * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = [tuple(r) for r in similar_components(odd, ngram, num, 100).collect()]
    assert Counter(got) == Counter((d, len(s), None if d is None else root(d)) for d, s in sets)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100)], "a long, b long")
    assert {r["component"] for r in components(links).collect()} == {0}


def test_repeats_equal_brute_force(odd):
    texts = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in odd_rows()]
    count = Counter(tuple(w[i : i + 35]) for _, w in texts for i in range(len(w) - 34))
    expected = []
    for doc_id, words in texts:
        gone = {j for i in range(len(words) - 34) if count[tuple(words[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        expected.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = without_repeats(odd).withColumn("sha", F.coalesce(F.sha2("kept", 256), "whole_sha256"))
    assert Counter(map(tuple, got.select("doc_id", "n_words", "n_removed", "sha").collect())) == Counter(expected)


def test_one_text_repeats_itself(spark):
    words = [f"a{i}" for i in range(35)]
    got = without_repeats(spark.createDataFrame([(1, " ".join(words * 2)), (2, " ".join(words[:34]))], "doc_id long, text string"))
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {1: 70, 2: 0}


def test_urls(spark):
    rules = spark.createDataFrame(
        [("org", "/", "allow"), ("Example.org", "/en/1", "block"), ("org", "/", "block"), (None, "/", "block")],
        "host string, path string, verdict string",
    )
    pages = [(1, "HTTP://A.Example.ORG/en/12?x"), (2, "http://example.org"), (3, None), (4, "no scheme"), (5, "http://xorg/"), (5, "http://xorg/")]
    pages = spark.createDataFrame([(*p, "host", "r") for p in pages], "page_id long, url string, host string, rule string")
    got = {tuple(r) for r in judge_urls(pages, rules).collect()}
    assert got == {
        (1, "a.example.org", "/en/12", "example.org/en/1", "block"), (2, "example.org", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "", "", None, "allow"), (5, "xorg", "/", None, "allow"),
    }
    assert judge_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == 6


def test_fingerprints(odd):
    rows = compared_with_edits(odd).collect()
    assert len(rows) == len(odd_rows())
    order = sorted((r for r in odd_rows() if r[0] is not None), key=lambda r: -r[0])
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["text"]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert max(map(len, by_text.values())) == 1
    one, following = next((a, b) for a, b in zip(order, order[1:]) if a[0] == 7)
    n, cut = len(one[1]), len(one[1]) // 3
    edited = next(r["edited"] for r in rows if r["doc_id"] == 7)
    assert edited == one[1][: n - cut] + (following[1] or "")[:cut]
    repeated = odd.sparkSession.createDataFrame([(1, "a b a b a b a"), (2, "a b")], "doc_id long, text string")
    assert compared_with_edits(repeated).select("fingerprint").distinct().count() == 2


def test_toxicity_and_quality_learn(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioustrln") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 2
        text = [rng.choice(words) + ("###" if bad else "") for _ in range(60)]
        if i % 4 > 1:
            text[7] = rng.choice(["dolt", "fool"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1 - bad, int(i % 4 > 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for column, fit, score in (("quality", fit_quality, quality_scores), ("toxic", fit_toxicity, toxicity_scores)):
        model = fit(docs, clean_labels(table, column, F.col("doc_id") < 300))
        got = score(docs, model).join(table.select("doc_id", F.col(column).alias("y")), "doc_id").where("doc_id >= 300 AND y IS NOT NULL")
        assert got.where((F.col("score") >= 0.5).cast("int") == F.col("y")).count() >= 95
        nothing = fit(docs, clean_labels(table, column, F.lit(False)))
        assert score(docs, nothing).select("score").distinct().count() == 1


def test_spans_equal_plain_patterns():
    card, phone = pii.CARD, pii.PHONE
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(3)
    parts = ["a", ".", "@", "-", "_", "+", "1", "9", "255", " ", "é", "(", ")", "x.y", "1.2.3", "4111 1111 1111 1111"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        expected = [(m.start(), 0, m.end()) for m in pii.EMAIL.finditer(text)]
        expected += [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        expected += [(m.start(), 2, m.end()) for m in card.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        expected += [(m.start(), 3, m.end()) for m in phone.finditer(text) if 9 <= len(digits(m)) <= 15]
        assert pii.base_spans(text) == sorted(expected)


def test_contexts_find_new_identifiers(spark):
    rows = [(i, f"please call my desk +1 (555) 555-{1000 + i} before noon") for i in range(30)]
    rows += [(100, "please call my desk 555-867-5309 before noon"), (101, "version 555-867-9999 of it"), (102, "so 555-867-5309 it is"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, d1 int, kind string")
    found = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert [(s["start"], s["stop"]) for s in found[100]["spans"]] == [(20, 32)] and not found[100]["base"]
    assert not found[101]["spans"] and not found[None]["spans"]
    assert [(s["start"], s["stop"]) for s in found[102]["spans"]] == [(3, 15)]  # the identifier is known by then
    masked = {r["doc_id"]: r["text"] for r in pii.masked(docs).collect()}
    assert masked[100] == masked[3] == "please call my desk <PHONE> before noon" and masked[None] is None


def test_contexts_find_what_most_patterns_miss(spark):
    rows = [f"please call me +1 (555) 555-{1000 + i} before noon" for i in range(20)]
    rows += [f"please call me 555-867-{5000 + i} before noon" for i in range(20)]  # half of them unseen
    rows += [f"write or ring +1 (555) 556-{1000 + i} today" for i in range(10)] + [f"write or ring a{i}@b.org today" for i in range(10)]
    rows += [f"write or ring 555-868-{5000 + i} today" for i in range(5)] + [f"write or ring b{i}@local today" for i in range(5)]
    rows += [f"the build number +1 (555) 557-{1000 + i} is" for i in range(10)] + [f"the build number 2.{i} is" for i in range(9)]
    rows += ["the build number 555-869-5000 is"]
    spans = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    kinds = [[s["kind"] for s in spans[i]["spans"]] for i in range(len(rows))]
    assert kinds[:40] == [[3]] * 40 and kinds[40:60] == [[3]] * 10 + [[0]] * 10
    assert kinds[60:70] == [[3]] * 5 + [[0]] * 5
    assert kinds[70:] == [[3]] * 10 + [[]] * 10  # a context with many other numbers vouches for none


def test_known_identifiers_are_found_everywhere(spark):
    rows = [f"please call my desk +1 (555) 555-{1000 + i} before noon" for i in range(10)]
    long = "x" * 70 + "5558675310"
    rows += ["please call my desk 555-867-5309 before noon", f"please call my desk {long} before noon"]
    known = "555-867-5309"
    places = [(f"{known} opens", 0), (f"so {known}", 3), (known, 0), (" " * 90 + known, 90), (f"see (call) ({known}", 12)]
    places += [(f'he said "{known}" to', 9), (f"a\u00a0{known}\r\nb", 2), (f"**{known}**", 2), (f"({known})", 1)]
    rows += [text for text, _ in places] + [f"{long} it is"]
    spans = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    got = [[(s["start"], s["kind"], s["stop"]) for s in spans[i]["spans"]] for i in range(10, len(rows))]
    assert got[:2] == [[(20, 3, 32)], [(20, 3, 100)]]
    assert got[2:] == [[(a, 3, a + 12)] for _, a in places] + [[(0, 3, 80)]]


def test_identifiers_with_blanks_are_found_whole(spark):
    rows = [f"please call my desk +1 (555) 555-{1000 + i} before noon" for i in range(10)]
    numbers = ["0171 234 5678", "(555) 555-1000", "0171 - 234 (56) 78", "555-867-5309"]
    rows += [f"please call my desk {n} before noon" for n in numbers]
    rows += ["0171 234 5678, 17 more", "17 of (0171 234 5678)", "the 12 555-867-5309", "and 0171 234 567 or 234", "in 2010 17 of 5678 x"]
    spans = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    got = [[rows[i][s["start"] : s["stop"]] for s in spans[i]["spans"]] for i in range(10, len(rows))]
    assert got == [[n] for n in numbers] + [["0171 234 5678"], ["0171 234 5678"], ["555-867-5309"], [], []]


def test_contexts_learn_until_nothing_is_new(spark):
    rows = [f"ask zero ring +1 (555) 555-{1000 + i} now" for i in range(5)]
    for step in range(6):  # each context is trusted by what the one before it taught
        rows += [f"{'ask zero ring' if step == 0 else f'{step} ask step{step}'} 555-{step:03}-{1000 + i} now{step}" for i in range(5)]
        rows += [f"ask step{step + 1} 555-{step:03}-{1000 + i} then{step}" for i in range(5)]
    found = pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert all([s["kind"] for s in r["spans"]] == [3] for r in found)


def test_tokens_equal_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(2)
    texts = [None, "", " ", "a  b", "it's <|endoftext|> x", "x" * 9000, "é" * 7001 + " z", " " * 9000 + "q", "=-" * 5000, "1" * 6000]
    texts += ["".join(rng.choice("abé ñ1\n") for _ in range(300)) for _ in range(20)]
    texts += ["".join(rng.choice("abcdeé") for _ in range(30_000)) + " end", "word " * 5000, "a'" + "s" * 5000]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    enc = bpe.encoding(VOCABULARY)
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert bpe.encode_text(enc, t or "") == ids
    for spread in (bpe.SPREAD, 2_000):
        monkeypatch.setattr(bpe, "SPREAD", spread)
        got = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect()
        expected = Counter((i // 2, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in enumerate(texts))
        assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["decoded"]) for r in got) == expected


def test_contamination_equals_brute_force(spark, odd):
    rows = odd_rows()
    passages = [" ".join((rows[12][1] + " " + rows[6][1]).split()[i : i + 14]) for i in (0, 3, 40)]
    items = [(i, t) for i, t in enumerate([*passages, "ONE", "one", None, "", "...", "the of"])] + [(1, passages[1]), (None, "one")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        words = word.findall(low(text))
        for i in range(max(1, len(words) - 9)) if words and item is not None else []:
            windows[tuple(words[i : i + 10])].add(str(item))
    expected = []
    for doc_id, text, *_ in rows:
        words, hit, met = word.findall(low(text)), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if found := windows.get(tuple(words[i : i + size])):
                    hit |= set(range(i, i + size))
                    met |= found
        expected.append((doc_id, len(words), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, contaminated(odd, benchmark).collect())) == Counter(expected)
    assert contaminated(odd, benchmark.limit(0)).where("contaminated").isEmpty()


def test_empty_tables(spark, none):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert similar_components(none).isEmpty() and without_repeats(none).isEmpty() and compared_with_edits(none).isEmpty()
    assert pii.find_pii(none).isEmpty() and pii.masked(none).isEmpty() and contaminated(none, benchmark).isEmpty()
    assert bpe.decode(bpe.encode(none, VOCABULARY), VOCABULARY).isEmpty()
    assert toxicity_scores(none, fit_toxicity(none, clean_labels(labels, "toxic", F.lit(True)))).isEmpty()
    assert quality_scores(none, fit_quality(none, clean_labels(labels, "quality", F.lit(True)))).isEmpty()


def test_odd_rows_have_scores_and_spans(spark, odd):
    labels = spark.createDataFrame([(8, 1, 0), (9, 0, 1)], "doc_id long, toxic int, quality int")
    for scores in (
        toxicity_scores(odd, fit_toxicity(odd, clean_labels(labels, "toxic", F.lit(True)))),
        quality_scores(odd, fit_quality(odd, clean_labels(labels, "quality", F.lit(True)))),
    ):
        assert scores.where("score BETWEEN 0 AND 1").count() == len(odd_rows())
    assert pii.find_pii(odd).count() == pii.masked(odd).count() == len(odd_rows())


def test_pipeline_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.written(stage(spark, docs, SMALL))
        assert 0 < docs.count() <= before and (name == "tokens" or docs.columns == columns)
        before = docs.count()


def test_url_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    mine = LLM_QUERIES["op3_url_filters"](spark, SMALL)
    theirs = connection.execute(f"SELECT {', '.join(mine.columns)} FROM ({LLM_ORACLES['op3_url_filters']})").fetchall()
    assert Counter(map(tuple, mine.collect())) == Counter(theirs)
