"""Quality by compression: how much shorter a text gets with a dictionary of good text than with one of bad text.

The normalised difference of the two sizes is calibrated to a score, together with how far the text shrinks at all:
text that repeats itself shrinks alike with any dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from cohortgrid.llm.labelled import logistic, sample, scored, sigmoid

PER_CLASS = 1_500  # labelled documents of a class that the dictionaries and the curve are fitted on, at most
DICTIONARY = 1 << 16  # bytes of a dictionary
BLOCK = 2_048  # bytes compressed at once: longer ones would learn more from the text than from the dictionary
LEVEL = 3


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    curve: tuple[float, ...]

    def scorer(self):
        """A function from a text to its score; compressors are made once a task."""
        sizes = [_sizer(d) for d in (self.good, self.bad)]
        curve = np.array(self.curve)
        return lambda text: sigmoid(np.append(measures(text, *sizes), 1.0) @ curve)


def _sizer(content: bytes):
    dictionary = zstandard.ZstdCompressionDict(content)
    dictionary.precompute_compress(level=LEVEL)
    compressor = zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_dict_id=False, write_checksum=False)
    return lambda data: sum(len(compressor.compress(data[a : a + BLOCK])) for a in range(0, len(data), BLOCK))


def measures(text: str, good, bad) -> np.ndarray:
    """Normalised difference, positive if the good dictionary serves better; log of the shrinkage, and its square.

    Zeros for an empty text.
    """
    data = text.encode()
    if not data:
        return np.zeros(3)
    a, b = good(data), bad(data)
    shrinkage = np.log(len(data) / min(a, b))
    return np.array([(b - a) / max(a, b), shrinkage, shrinkage**2])


def _dictionary(texts: list[str]) -> bytes:
    parts = [data[a : a + BLOCK] for data in map(str.encode, texts) for a in range(0, len(data), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return zstandard.ZstdCompressionDict(b"".join(parts)[-DICTIONARY:] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT).as_bytes()


def fit_quality(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> CompressionModel:
    """labels (doc_id, label), 1 for good. Two thirds of the sample make the dictionaries, one third the score's curve.

    The curve's classes weigh as in all labels. Without labels of both classes every score is the share of good ones,
    or a half without any.
    """
    rows, counts = sample(documents, labels, per_class)
    rows = rows[rows["text"] != ""]
    total = sum(counts.values())
    if not total or rows["label"].nunique() < 2:
        share = min(max(counts[1] / total if total else 0.5, 1e-6), 1 - 1e-6)
        return CompressionModel(b"", b"", (float(np.log(share / (1 - share))),))
    for_curve = np.arange(len(rows)) % 3 == 2
    if rows[for_curve]["label"].nunique() < 2 or rows[~for_curve]["label"].nunique() < 2:
        for_curve[:] = True
        rest = rows
    else:
        rest = rows[~for_curve]
    dictionaries = [_dictionary(rest[rest["label"] == k]["text"].tolist()) for k in (1, 0)]
    sizes = [_sizer(d) for d in dictionaries]
    curve = rows[for_curve]
    x = np.array([measures(t, *sizes) for t in curve["text"]])
    y = curve["label"].to_numpy(float)
    share = {k: counts[k] / max(1, (y == k).sum()) for k in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    fitted = logistic(x, y, weight * len(y) / weight.sum(), ridge=1e-3)
    return CompressionModel(*dictionaries, tuple(map(float, fitted)))


def quality_scores(documents: DataFrame, model: CompressionModel) -> DataFrame:
    """(doc_id, score), a row for each document: 0 to 1, higher for good text. Null is an empty text, whose score is
    the curve's where nothing shrinks and neither dictionary serves better. Whole texts count. Other columns are ignored."""
    if not model.good:
        return scored(documents, lambda: lambda text: sigmoid(model.curve[-1]))
    return scored(documents, model.scorer)
