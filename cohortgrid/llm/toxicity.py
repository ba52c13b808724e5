"""Toxicity by weak supervision: many lexicon and pattern voters, a generative model of their votes, a linear classifier.

Tasks read the texts of the labelled sample and count their features; the driver gets the listed features' numbers only.
Lexicons are words and word stems that the labelled sample shows to mark either class; patterns look at the form of
a text. The label model sees no label: it estimates by expectation and maximisation how often each voter is right, and
takes weight from voters that err together. The classifier learns its posterior labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from cohortgrid.llm.common import MEMO_WORDS, mix, slices, written
from cohortgrid.llm.labelled import sampled, scored, sigmoid

PER_CLASS = 3_000  # labelled documents of a class that the model is fitted on, at most
STEMS = (4, 5, 6)  # letters of the stems that count as features beside whole words
HELD = 300_000  # features that a task counts before it hands them on
BANDS, ROWS = 12, 2  # min-hash keys of a text, and minima in a key
ALIKE = 0.5  # Jaccard similarity of the words of near copies
CHANCE = 0.01  # features that may enter a lexicon by chance alone, about, however many are tried
LEXICONS = 8  # toxic lexicons that strong and weak features are dealt to, and as many clean ones
WORD = regex.compile(r"[^\W\d_]+")
PATTERNS = (
    regex.compile(r"\b(?:you|your|du|tu|vous|eres)\b.{0,20}\b(?:are|bist|es|êtes|eres)\b"),
    regex.compile(r"[!?]{3,}"),
    regex.compile(r"\b\p{Lu}{3,}\b(?:\W+\b\p{Lu}{3,}\b){2,}"),
    regex.compile(r"\p{L}\*{2,}\p{L}"),
)


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in STEMS if len(word) > n)]


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    offset: float

    def scorer(self):
        memo: dict[str, float] = {}

        def weight(word: str) -> float:
            value = memo.get(word)
            if value is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                value = memo[word] = sum(self.weights.get(f, 0.0) for f in features_of(word))
            return value

        return lambda text: sigmoid(self.offset + sum(map(weight, words_of(text))))


def _read_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, words, patterns, bands): distinct words, votes of the patterns, min-hash keys of the words."""
    for batch in slices(batches, 256):
        texts = batch.column("text").to_pylist()
        words = [sorted(words_of(t)) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("label"),
                pa.array(words, pa.list_(pa.string())),
                pa.array([[int(bool(p.search(t))) for p in PATTERNS] for t in texts], pa.list_(pa.int32())),
                pa.array([bands(w) for w in words], pa.list_(pa.int64())),
            ],
            ["doc_id", "label", "words", "patterns", "bands"],
        )


def bands(words: list[str]) -> list[int]:
    """BANDS keys; sets that share most words share a key. None without words."""
    if not words:
        return []
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    with np.errstate(over="ignore"):
        least = [mix(hashes ^ mix(np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))).min() for k in range(BANDS * ROWS)]
        joined = [mix(np.array(least[i : i + ROWS]) * np.uint64(2 * i + 3)).sum(dtype=np.uint64) for i in range(0, len(least), ROWS)]
    return [int(x) for x in np.array(joined, np.uint64).view(np.int64)]


def one_of_kind(rows: DataFrame) -> DataFrame:
    """rows without the near copies of others of their label: words that copies share by chance would look like evidence.

    A row goes if it shares ALIKE of its words, by Jaccard, with the row of smallest doc_id that shares a min-hash key
    with it. Rows that are no near copies always stay.
    """
    keyed = rows.select("doc_id", "label", F.explode("bands").alias("band"))
    firsts = keyed.groupBy("label", "band").agg(F.min("doc_id").alias("first"))
    pairs = keyed.join(firsts, ["label", "band"]).where("first < doc_id").select("doc_id", "first").distinct()
    sides = pairs.join(rows.select("doc_id", "words"), "doc_id")
    sides = sides.join(rows.select(F.col("doc_id").alias("first"), F.col("words").alias("others")), "first")
    shared = F.size(F.array_intersect("words", "others"))
    alike = shared >= ALIKE * (F.size("words") + F.size("others") - shared)
    return rows.join(sides.where(alike).select("doc_id").distinct(), "doc_id", "left_anti")


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, ones, n): texts of a task with a feature, those of label 1 and all."""
    seen: list[dict[str, int]] = [{}, {}]

    def out() -> pa.RecordBatch:
        names = list(seen[0].keys() | seen[1].keys())
        ones = [seen[1].get(f, 0) for f in names]
        n = [seen[0].get(f, 0) + k for f, k in zip(names, ones)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ones, pa.int64()), pa.array(n, pa.int64())], ["f", "ones", "n"])

    for batch in slices(batches, 64):
        for label, words in zip(batch.column("label").to_pylist(), batch.column("words").to_pylist()):
            counts = seen[label]
            for f in {f for w in words for f in features_of(w)}:
                counts[f] = counts.get(f, 0) + 1
        if len(seen[0]) + len(seen[1]) >= HELD:
            yield out()
            seen = [{}, {}]
    yield out()


def lexicons(rows: DataFrame, counts: dict[int, int]) -> tuple[list[str], list[str]]:
    """Features that favour label 1, and label 0, the strongest first; rows (doc_id, label, words), counts of all labels.

    A feature has to speak for its label more often than chance explains, and to be right more often than wrong among
    all labels: a voter that errs more often than not misleads the label model.
    """
    counted = rows.select("label", "words").mapInArrow(_count_features, "f string, ones long, n long")
    found = written(counted.groupBy("f").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")))
    total, share = rows.agg(F.count("*"), F.avg("label")).first()
    evidence = float(np.sqrt(2 * np.log(max(2, found.count()) / CHANCE)))  # the tail of a normal deviate
    if not total or not 0 < share < 1:
        return [], []
    parts = [
        F.when(k > 0, k * F.log(k / (F.col("n") * s))).otherwise(0.0)
        for k, s in ((F.col("ones"), share), (F.col("n") - F.col("ones"), 1 - share))
    ]
    strength = F.signum(F.col("ones") - F.col("n") * share) * F.sqrt(F.greatest(F.lit(0.0), 2 * (parts[0] + parts[1])))
    one, zero = counts[1] / (total * share) * F.col("ones"), counts[0] / (total * (1 - share)) * (F.col("n") - F.col("ones"))
    right = F.when(strength > 0, one >= zero).otherwise(zero >= one)
    strong = found.select("f", strength.alias("s"), right.alias("right")).where("right").where(F.abs("s") >= evidence).collect()
    ranked = sorted((-abs(r["s"]), r["f"], r["s"] > 0) for r in strong)
    return [f for _, f, up in ranked if up], [f for _, f, up in ranked if not up]


def _listed(names: list[str]):
    """(doc_id, label, patterns, at): the places of a text's listed features, once for each word that has them."""
    place = {f: j for j, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [[place[f] for w in words for f in features_of(w) if f in place] for words in batch.column("words").to_pylist()]
            kept = [batch.column(c) for c in ("doc_id", "label", "patterns")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(at, pa.list_(pa.int32()))], ["doc_id", "label", "patterns", "at"])

    return run


def votes(places: list[np.ndarray], patterns: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """1, -1 or 0 (no opinion) of each voter on each text: all toxic lexicons as one, each lexicon, the patterns. Toxic
    features stand before clean ones, and both are dealt to their lexicons in turn."""
    toxic, clean = min(LEXICONS, n_toxic), min(LEXICONS, n_clean)
    out = np.zeros((len(places), 1 + toxic + clean), np.int8)
    for i, at in enumerate(places):
        low, high = at[at < n_toxic], at[at >= n_toxic] - n_toxic
        out[i, 1 + low % LEXICONS] = 1
        out[i, 1 + toxic + high % LEXICONS] = -1
        out[i, 0] = len(low) > 0
    return np.hstack([out, patterns.astype(np.int8)])


def label_model(matrix: np.ndarray, prior: float, rounds: int = 50) -> np.ndarray:
    """Posterior probability of label 1 from votes, by a generative model.

    Each voter has, for either label, its rates of speaking for 1, for 0 and not at all. Voters whose deviations from
    what the model expects go together are no independent witnesses: a vote counts by one over the sum of its
    voter's squared correlations with all voters. Silence counts as the model finds it; a vote never counts against what
    it says. Starts from the share prior
    of texts on which most voters speak for 1.
    """
    n, m = matrix.shape
    said = matrix.sum(1)
    posterior = np.where(said > max(0.0, np.quantile(said, 1 - prior) - 1e-9), 0.95, 0.05)
    onehot = np.stack([(matrix == v).astype(float) for v in (-1, 0, 1)], 2)
    weight = np.ones(m)
    for _ in range(rounds):
        rates = []
        for p in (1 - posterior, posterior):
            count = np.einsum("i,ijv->jv", p, onehot)
            rates.append((count + 0.5) / (count.sum(1, keepdims=True) + 1.5))
        expected = sum(p[:, None] * (r[:, 2] - r[:, 0]) for p, r in zip((1 - posterior, posterior), rates))
        rest = matrix - expected
        spread = rest.std(0)
        rest = np.where(spread > 1e-9, (rest - rest.mean(0)) / np.maximum(spread, 1e-9), 0.0)
        correlation = rest.T @ rest / n
        np.fill_diagonal(correlation, 1.0)
        weight = 1.0 / np.square(correlation).sum(1)
        speaks = np.log(rates[1]) - np.log(rates[0])
        speaks[:, 0], speaks[:, 2] = np.minimum(speaks[:, 0], 0), np.maximum(speaks[:, 2], 0)
        logs = np.einsum("ijv,jv->ij", onehot, speaks) @ weight
        now = sigmoid(logs + np.log(prior / (1 - prior)))
        if np.abs(now - posterior).max() < 1e-6:
            return now
        posterior = now
    return posterior


def linear(places: list[np.ndarray], size: int, target: np.ndarray, weight: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression on the number of a text's words with each feature."""
    rows = np.repeat(np.arange(len(places)), [len(p) for p in places])
    columns = np.concatenate([*places, np.empty(0, np.int64)]).astype(np.int64)
    w, offset = np.zeros(size), 0.0
    square_w, square_o = np.full(size, 1e-8), 1e-8
    for _ in range(steps):
        z = offset + np.bincount(rows, w[columns], len(places))
        slope = weight * (sigmoid(z) - target)
        gradient = np.bincount(columns, slope[rows], size) + 1e-3 * len(places) * w / max(1, size)
        square_w += gradient**2
        square_o += slope.sum() ** 2
        w -= 0.5 * gradient / np.sqrt(square_w)
        offset -= 0.5 * slope.sum() / np.sqrt(square_o)
    return w, float(offset)


def fit_toxicity(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """labels (doc_id, label), 1 for toxic. Without both labels every score is the share of toxic ones, or a half.

    The labels serve the lexicons and the share of toxic text alone; the classifier learns what the votes on the sample
    say, each class with the weight that it has among all labels.
    """
    texts, counts = sampled(documents, labels, per_class)
    total = sum(counts.values())
    prior = min(max(counts[1] / total if total else 0.5, 1e-6), 1 - 1e-6)
    kind = documents.schema["doc_id"].dataType.simpleString()
    read = texts.mapInArrow(
        _read_sample, f"doc_id {kind}, label int, words array<string>, patterns array<int>, bands array<bigint>"
    )
    rows = written(one_of_kind(written(read)).select("doc_id", "label", "words", "patterns"))
    toxic, clean = lexicons(rows, counts)
    names = [*toxic, *clean]
    held = rows.mapInArrow(_listed(names), f"doc_id {kind}, label int, patterns array<int>, at array<int>").toPandas()
    held = held.sort_values("doc_id", ignore_index=True)
    y = held["label"].to_numpy(int)
    if len(set(y.tolist())) < 2:
        return ToxicityModel({}, float(np.log(prior / (1 - prior))))
    places = [np.asarray(p, np.int64) for p in held["at"]]
    matrix = votes(places, np.array(held["patterns"].to_list()), len(toxic), len(clean))
    share = np.array([counts[k] / max(1, (y == k).sum()) for k in (0, 1)])
    weight = share[y] * len(y) / share[y].sum()
    target = label_model(matrix, float(y.mean()))
    w, offset = linear(places, len(names), target, weight)
    return ToxicityModel({f: float(x) for f, x in zip(names, w) if x}, offset)


def toxicity_scores(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score), a row for each document: 0 to 1, higher for toxic text. Null is an empty text, whose score comes
    from the offset alone. Whole texts count, each word once. Other columns are ignored."""
    return scored(documents, model.scorer)
