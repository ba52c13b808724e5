"""Spelling variants, ranked search and sharding against brute force, and on odd rows and empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortgrid.llm import lexical_search, sharding, spelling
from cohortgrid.llm.lexical_search import Best, exact_slices, ranked_documents
from cohortgrid.llm.queries import LLM_QUERIES
from cohortgrid.llm.sharding import fisher_yates, shuffled_shards, write_shards
from cohortgrid.llm.spelling import corpus_words, variant_forms

SCHEMA = "doc_id long, text string, lang string, word string, n long, shard int, slot string, cell long, rank int"


def odd_rows():
    rng = random.Random(3)
    alphabet = "abcdé"
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(6, 10))) for _ in range(60)]
    words = base + [w[:3] + rng.choice(alphabet) + w[4:] for w in base] + [w[:2] + w[3:] for w in base] + ["ÀÉ÷ñaZz", "x" * 300, "x" * 299]
    texts = [" ".join(rng.choices(words, [5] * 60 + [1] * (len(words) - 60), k=rng.randint(1, 300))) for _ in range(40)]
    texts += [None, "", " \n", "One, two; ONE 3 é", texts[0], texts[0], " ".join(words * 40), "a" * 20_000, "a" * 20_000]
    rows = [(i, t, "en", "w", 1, 9, "s", 5, 2) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[1], *[None] * 7), (None, None, *[None] * 7)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def forms_of(counts, ratio):
    forms, numbers = {}, {}
    by_length = defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    for w, n in counts.items():
        others = [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if near(w, x)]
        numbers[w] = len(others)
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best and counts[best] >= ratio * n:
            forms[w] = best

    def root(w):
        return root(forms[w]) if w in forms else w

    return {(w, forms.get(w), root(w), n, numbers[w], counts.get(forms.get(w))) for w, n in counts.items()}


def words_of(rows, slip):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


@pytest.mark.parametrize("slip,ratio", [(31, 10), (3, 2)])
@pytest.mark.parametrize("cell", [spelling.CELL, 300])
def test_variants_equal_brute_force(odd, monkeypatch, slip, ratio, cell):
    monkeypatch.setattr(spelling, "CELL", cell)  # small: many cells, split by hashes
    monkeypatch.setattr(spelling, "ASKED", 2)
    monkeypatch.setattr(spelling, "HELD", 10)
    got = [tuple(r) for r in variant_forms(corpus_words(odd, 7, 2, slip), ratio).collect()]
    want = forms_of(words_of(odd_rows(), slip), ratio)
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] for r in want)


def test_variants_of_words_with_equal_letters(spark, monkeypatch):
    """Anagrams share a point; only those one edit apart are near."""
    monkeypatch.setattr(spelling, "LEAF", 2)
    rng = random.Random(1)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(500)} | {"".join(rng.sample("abcdefg", 7)) for _ in range(500)}
    words |= {w.replace("a", "z", 1) for w in list(words)[:50]}
    counts = {w: rng.randint(2, 40) for w in words}
    table = spark.createDataFrame([(w.encode("latin-1"), n) for w, n in counts.items()], "word binary, n long")
    assert {tuple(r) for r in variant_forms(table, 3).collect()} == forms_of(counts, 3)


def test_roots_follow_long_chains(spark):
    counts = {"a" * 7 + "b" * i: 2 * 3**i for i in range(9)}
    table = spark.createDataFrame([(w.encode(), n) for w, n in counts.items()], "word binary, n long")
    got = {tuple(r) for r in variant_forms(table, 3).collect()}
    assert got == forms_of(counts, 3) and {r[2] for r in got} == {"a" * 7 + "b" * 8}


def test_a_query_of_variants(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in LLM_QUERIES["op11_spelling_variants"](spark, folder).collect()}
    want = words_of([tuple(r) for r in docs], 31)
    assert {(r[0], r[3]) for r in got} == set(want.items())
    some = dict(sorted(want.items())[:300])
    for word, n in some.items():
        others = [x for x in want if abs(len(x) - len(word)) < 2 and near(x, word)]
        row = next(r for r in got if r[0] == word)
        assert row[3] == n and row[4] == len(others)


def scores_of(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    bags = [(d, Counter(split(t))) for d, t, *_ in docs]
    filled = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        ranked = []
        for doc_id, bag in bags:
            if not bag:
                continue
            m = 25 + 75 * sum(bag.values()) * filled // total
            score = sum(
                math.floor(1000 * math.log((2 * filled + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                for t in split(text)
                if t in bag
            )
            if score > 0:
                ranked.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, null, doc_id) in enumerate(sorted(ranked)[:k], 1):
            out.append((item_id, rank, None if null else doc_id, -score))
    return Counter(out)


ITEMS = [(0, "one two two"), (1, None), (2, ""), (3, "ÀÉ÷ñaZz x " + "x" * 300), (3, "one"), (3, "one"), (None, "3 é"), (4, "zzz")]


@pytest.mark.parametrize("k,tile,load", [(1, 64, 16 << 20), (3, 2, 16 << 20), (10, 64, 9000), (10, 64, 16 << 20)])
def test_search_equals_brute_force(spark, odd, monkeypatch, k, tile, load):
    monkeypatch.setattr(lexical_search, "ITEM_TILE", tile)
    monkeypatch.setattr(lexical_search, "DOC_TILE", 7)
    monkeypatch.setattr(lexical_search, "TERM_TILE", 3)
    monkeypatch.setattr(lexical_search, "VOCABULARY_BYTES", load)
    items = [*ITEMS, *[(10 + i, t) for i, (_, t, *_) in enumerate(odd_rows()[:20])]]
    table = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, item long, doc_id long")
    got = Counter(tuple(r) for r in ranked_documents(odd, table, k).collect())
    assert got == scores_of(odd_rows(), items, k)


def test_weights_are_cut_below_the_exact_bound():
    room = (lexical_search.EXACT - 1) // lexical_search.IMPACT
    weights = np.array([[room - 1, 3, 2, 3 * room + 5, 1], [1, 0, room, 7, 0]], np.int64)
    total = np.zeros_like(weights)
    for some, part in exact_slices(weights):
        assert part.sum(axis=1).max() * lexical_search.IMPACT < lexical_search.EXACT
        total[:, some] += part.astype(np.int64)
    assert (total == weights).all()


def test_ties_at_the_last_place_go_by_id():
    best = Best(1, 3)
    for docs in (np.arange(50, 100), np.arange(0, 50)):
        best.meet(0, np.full(50, 7), docs)
    best.meet(0, np.array([9]), np.array([500]))
    assert best.held[0][0].tolist() == [9, 7, 7] and best.held[0][1].tolist() == [500, 0, 1]


def test_search_without_documents_or_items(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_documents(none, items).count() == 0
    assert ranked_documents(odd, items.limit(0)).count() == 0


def test_no_words_no_forms(none):
    assert variant_forms(corpus_words(none)).count() == 0


@pytest.mark.parametrize("shards,load", [(8, 64 << 20), (3, 2000), (100, 64 << 20)])
def test_shards_hold_every_record_once(odd, shards, load):
    placed = shuffled_shards(odd, shards, 5, load)
    assert placed.columns == [c for c in odd.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    rows = placed.collect()
    kept = lambda r: (r[0], r[1], r[2], r[3], r[4], r[7], r[8])  # noqa: E731  all but shard and slot
    assert Counter(tuple(r)[:-2] for r in rows) == Counter(map(kept, odd_rows()))
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
    for shard, size in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(size))
    again = shuffled_shards(odd, shards, 5, load).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    if 1 < shards < 10:
        other = shuffled_shards(odd, shards, 6, load).collect()
        assert Counter(map(tuple, rows)) != Counter(map(tuple, other))


def test_shards_of_nothing(none):
    assert shuffled_shards(none, 4).count() == 0


def test_order_is_uniform():
    seen = Counter(tuple(fisher_yates(4, (7, i))) for i in range(24_000))
    assert len(seen) == 24 and all(abs(n - 1000) < 6 * math.sqrt(1000) for n in seen.values())


def test_copies_of_one_record_spread(spark):
    copies = spark.createDataFrame([(1, "same")] * 4000, "doc_id long, text string").repartition(2)
    tagged = copies.withColumns({"_tag": F.xxhash64("doc_id", "text"), "_task": F.spark_partition_id()})
    dealt = tagged.mapInArrow(sharding._scatter(16, 0), "doc_id long, text string, _bucket int, _tag long")
    sizes = [r["count"] for r in dealt.groupBy("_bucket").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 250


def test_written_shards(spark, odd, tmp_path):
    table = write_shards(odd, str(tmp_path / "out"), 3, 1)
    assert table.count() == odd.count() and len(list((tmp_path / "out").glob("shard=*"))) == 3
