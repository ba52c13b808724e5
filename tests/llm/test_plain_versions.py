"""Fingerprints, the label model and compressed sizes against plain versions of the same methods."""

import random

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from cohortgrid.llm import fingerprints, quality, toxicity

M64 = (1 << 64) - 1


def long_hash(value: int, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest((value & M64).to_bytes(8, "little"), seed & M64)


def plain_fingerprint(text, spark_hash):
    """Order min-hash, a bin at a time: occurrence-numbered k-mers, the smallest of each bin, in text order."""
    words = [w for w in __import__("re").split(fingerprints.SPACE, text or "") if w]
    size = fingerprints.KMER
    if not words:
        return [None] * fingerprints.BINS
    kmers = [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    seen, bins = {}, {}
    for place, kmer in enumerate(kmers):
        number = seen.get(kmer, 0)
        seen[kmer] = number + 1
        bins.setdefault(spark_hash(kmer, number)[0], []).append((spark_hash(kmer, number)[1], place, kmer))
    out = [None] * fingerprints.BINS
    for b, found in bins.items():
        kept = sorted(found)[: fingerprints.TUPLE]
        out[b] = tuple(k for _, _, k in sorted(kept, key=lambda x: x[1]))
    return out


def test_fingerprints_equal_plain_order_min_hash(spark):
    """Two texts agree in a bin exactly where the plain version's tuples agree."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "a b".replace(" ", "_")]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 30, 80, 300]))) for _ in range(60)]
    texts += [texts[5] + " w1", "w1 " + texts[5], texts[7].replace("w3", "w4"), "", "one", None]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["m"] for r in table.select("i", fingerprints.fingerprint(F.col("text")).alias("m")).collect()}

    memo = {}

    def spark_hash(kmer, number):
        """(bin, order) of a numbered k-mer, as Spark's xxhash64 chains its columns."""
        if (kmer, number) not in memo:
            words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in kmer]
            value = 42
            for w in words:
                value = long_hash(w, value)
            head = value >> 32  # 32 bits of the k-mer's hash
            numbered = xxhash.xxh64_intdigest(number.to_bytes(4, "little"), long_hash(head))
            top = numbered >> 32
            memo[kmer, number] = top >> (32 - fingerprints.BINS.bit_length() + 1), top
        return memo[kmer, number]

    plain = {i: plain_fingerprint(t, spark_hash) for i, t in enumerate(texts)}
    for i in plain:
        assert [x is None for x in got[i]] == [x is None for x in plain[i]], texts[i]
    for i in plain:
        for j in plain:
            same = [a == b for a, b in zip(plain[i], plain[j])]
            assert [a == b for a, b in zip(got[i], got[j])] == same


def plain_label_model(matrix, prior, rounds=50):
    """The same model, vote by vote."""
    n, m = matrix.shape
    said = matrix.sum(axis=1)
    bar = max(0.0, np.quantile(said, 1 - prior) - 1e-9)
    posterior = [0.95 if s > bar else 0.05 for s in said]
    for _ in range(rounds):
        rates = [[[0.5] * 3 for _ in range(m)] for _ in (0, 1)]
        for i in range(n):
            for j in range(m):
                rates[0][j][matrix[i, j] + 1] += 1 - posterior[i]
                rates[1][j][matrix[i, j] + 1] += posterior[i]
        rates = [[[v / sum(r) for v in r] for r in side] for side in rates]
        rest = np.array([[matrix[i, j] - sum(p * (side[j][2] - side[j][0]) for p, side in ((1 - posterior[i], rates[0]), (posterior[i], rates[1]))) for j in range(m)] for i in range(n)])
        spread = rest.std(axis=0)
        rest = np.array([[(rest[i, j] - rest[:, j].mean()) / spread[j] if spread[j] > 1e-9 else 0.0 for j in range(m)] for i in range(n)])
        weight = []
        for j in range(m):
            weight.append(1 / sum(1.0 if j == k else (rest[:, j] @ rest[:, k] / n) ** 2 for k in range(m)))
        now = []
        for i in range(n):
            log = np.log(prior / (1 - prior))
            for j in range(m):
                v = matrix[i, j] + 1
                speaks = np.log(rates[1][j][v]) - np.log(rates[0][j][v])
                log += weight[j] * (min(speaks, 0) if v == 0 else max(speaks, 0) if v == 2 else speaks)
            now.append(1 / (1 + np.exp(-np.clip(log, -40, 40))))
        if max(abs(a - b) for a, b in zip(now, posterior)) < 1e-6:
            return np.array(now)
        posterior = now
    return np.array(posterior)


def test_label_model_equals_plain_expectation_maximisation():
    rng = np.random.default_rng(2)
    y = rng.random(80) < 0.25
    matrix = np.zeros((80, 6), np.int8)
    for j in range(5):
        speaks = rng.random(80) < 0.5
        right = rng.random(80) < 0.9
        says = np.where(y == right, 1, -1)
        matrix[:, j] = np.where(speaks, says if j < 3 else np.minimum(says, 0) if j == 3 else np.maximum(says, 0), 0)
    matrix[:, 5] = matrix[:, 0]  # two voters that always agree
    got = toxicity.label_model(matrix, 0.25)
    assert np.allclose(got, plain_label_model(matrix.astype(int), 0.25), atol=1e-6)
    assert ((got > 0.5) == y).mean() > 0.8


@pytest.mark.parametrize("words", [3, 400, 5000])
def test_measures_equal_plain_zstandard(words):
    rng = random.Random(words)
    good = " ".join(f"good{rng.randint(0, 50)}" for _ in range(3000)).encode()
    bad = " ".join(f"bad{rng.randint(0, 50)}#" for _ in range(3000)).encode()
    text = " ".join(rng.choice(["good1", "good2", "bad3#", "é"]) for _ in range(words))
    sizes = []
    for content in (good, bad):
        total, data = 0, text.encode()
        for at in range(0, len(data), quality.BLOCK):
            compressor = zstandard.ZstdCompressor(
                level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False, write_checksum=False
            )
            total += len(compressor.compress(data[at : at + quality.BLOCK]))
        sizes.append(total)
    a, b = sizes
    shrink = np.log(len(text.encode()) / min(a, b))
    got = quality.measures(text, quality._sizer(good), quality._sizer(bad))
    assert np.allclose(got, [(b - a) / max(a, b), shrink, shrink**2], rtol=0.02, atol=0.01)
    assert (quality.measures("", None, None) == 0).all()


def test_dictionaries_of_long_texts_take_linear_time():
    import time

    began = time.time()
    quality._dictionary(["word " * 1_000_000])
    assert time.time() - began < 20
