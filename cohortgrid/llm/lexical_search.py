"""Ranked lexical search: the documents that score highest for each item, by blocked dense multiplication.

A document's impact for a term and an item's weight of it are integers, so a score is a product of an impact matrix and
a weight matrix. One pass over the texts keeps each document's counts of item terms; their sums are the corpus
statistics. Items are dealt into tiles with a compact vocabulary each, documents into tiles of rows; a tile of impacts
times a tile of weights is one matrix product in float64. Terms go into slices whose sums stay below 2^53, so
every partial sum is exact, and slices add up in 64-bit integers. Of each product a task keeps, per item, the best
documents it has met, ties by doc_id; Spark ranks what the tasks keep.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortgrid.llm.common import byte_texts, slices, written

EXACT = 1 << 53
IMPACT = 1_000_000  # above every impact: (10^9 tf) div (1000 tf + 8 m) with m of 25 or more
ITEM_TILE = 64  # items of a tile
DOC_TILE = 1024  # documents of a tile
TERM_TILE = 4096  # terms of a slice at most
VOCABULARY_BYTES = 16 << 20  # of item texts that one round takes to the tasks, about
TEXTS = 512  # texts in memory at once

#: What separates terms: ASCII that is neither letter nor digit. A-Z become lower case.
_CLEAN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Terms of UTF-8 text: runs of ASCII letters, digits and all that is not ASCII; A-Z in lower case."""
    return text.translate(_CLEAN).split()


@dataclass(frozen=True)
class Tile:
    """Items of a tile: their numbers, the terms they use, and how often (items x terms)."""

    items: np.ndarray
    terms: np.ndarray
    times: np.ndarray


def item_tiles(texts: list[bytes], vocabulary: dict[bytes, int], df: np.ndarray) -> list[Tile]:
    """Items whose terms are alike stand together: by their most frequent terms of all."""
    used = []
    for text in texts:
        counts = Counter(terms_of(text))
        ids = np.array([vocabulary[t] for t in counts], np.int64)
        used.append((ids, np.fromiter(counts.values(), np.int64, len(counts))))
    order = sorted(range(len(texts)), key=lambda i: (sorted(-df[used[i][0]])[:1], sorted(used[i][0], key=lambda t: -df[t])[:4]))
    tiles = []
    for at in range(0, len(order), ITEM_TILE):
        some = [i for i in order[at : at + ITEM_TILE] if len(used[i][0])]
        if not some:
            continue
        terms = np.unique(np.concatenate([used[i][0] for i in some]))
        times = np.zeros((len(some), len(terms)), np.int64)
        for row, i in enumerate(some):
            times[row, np.searchsorted(terms, used[i][0])] = used[i][1]
        tiles.append(Tile(np.array(some), terms, times))
    return tiles


def exact_slices(weights: np.ndarray) -> list[tuple[slice, np.ndarray]]:
    """(terms, weights x terms as float64) that add up to weights; IMPACT times any row sum of one stays below 2^53."""
    room = (EXACT - 1) // IMPACT
    out, at = [], 0
    while at < weights.shape[1]:
        ends = np.cumsum(weights[:, at : at + TERM_TILE], axis=1).max(axis=0)
        stop = at + int(np.searchsorted(ends, room, "right"))
        if stop > at:
            out.append((slice(at, stop), weights[:, at:stop].astype(float)))
            at = stop
            continue
        left = weights[:, at].copy()  # one term weighs too much: it goes in several parts
        while left.any():
            part = np.minimum(left, room)
            out.append((slice(at, at + 1), part[:, None].astype(float)))
            left -= part
        at += 1
    return out


def _count_terms(vocabulary: dict[bytes, int]):
    """(doc_id, n, terms, times): all terms of a text counted, those of the vocabulary by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS):
            n, terms, times = [], [], []
            for text in byte_texts(batch.column("text")):
                words = terms_of(text)
                counts = Counter(words)
                known = [t for t in counts if t in vocabulary]
                n.append(len(words))
                terms.append(np.fromiter((vocabulary[t] for t in known), np.int32, len(known)))
                times.append(np.fromiter((counts[t] for t in known), np.int32, len(known)))
            ends = pa.array(np.cumsum([0, *map(len, terms)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], pa.int32())) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    return run


def _frequencies(size: int):
    """(term, df) of a task's documents; -1 counts those with terms, -2 all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, filled, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
            n = batch.column("n").to_numpy()
            filled, total = filled + int((n > 0).sum()), total + int(n.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, -2, at].astype(np.int64)), pa.array(np.r_[filled, total, df[at]].astype(np.int64))], ["term", "df"]
        )

    return run


class Best:
    """For each item the best documents met so far: highest score first, equal scores by doc_id, null last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * items
        self.least = np.ones(items, np.int64)  # what a score has to reach

    def meet(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """docs: doc_ids, null as the largest number; ties at the k-th place are all compared."""
        at = np.flatnonzero(scores >= self.least[item])
        if len(at) > 4 * self.k:
            cut = np.partition(scores[at], len(at) - self.k)[len(at) - self.k]
            at = at[scores[at] >= cut]
        if not len(at):
            return
        score = np.r_[self.held[item][0], scores[at]]
        doc = np.r_[self.held[item][1], docs[at]]
        order = np.lexsort((doc, -score))[: self.k]
        self.held[item] = score[order], doc[order]
        if len(order) == self.k:
            self.least[item] = score[order[-1]]


NULL_ID = np.iinfo(np.int64).max


def _multiply(tiles: list[tuple[np.ndarray, np.ndarray, list]], size: int, items: int, k: int, filled: int, total: int):
    """(item, doc_id, score): each task's best k documents for each item. tiles: items, terms, exact slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, k)
        column = np.full(size, -1)
        for batch in slices(batches, DOC_TILE):
            docs = batch.column("doc_id").fill_null(NULL_ID).to_numpy()
            n = batch.column("n").to_numpy()
            m = 25 + np.array([75 * x * filled // total for x in n.tolist()], np.int64)  # Python's integers: no overflow
            lists = batch.column("terms")
            term, tf = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
            for numbers, terms, parts in tiles:
                column[terms] = np.arange(len(terms))
                at = column[term]
                inside = at >= 0
                matrix = np.zeros((len(terms), len(n)))
                matrix[at[inside], row[inside]] = impact[inside]
                column[terms] = -1
                scores = np.zeros((len(numbers), len(n)), np.int64)
                for some, weights in parts:
                    scores += (weights @ matrix[some]).astype(np.int64)
                for i in np.flatnonzero(scores.max(axis=1, initial=0) >= best.least[numbers]):
                    best.meet(numbers[i], scores[i], docs)
        sizes = [len(s) for s, _ in best.held]
        doc = np.concatenate([d for _, d in best.held]) if items else np.empty(0, np.int64)
        score = np.concatenate([s for s, _ in best.held]) if items else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(items), sizes)), pa.array(doc, mask=doc == NULL_ID), pa.array(score)],
            ["item", "doc_id", "score"],
        )

    return run


def ranked_documents(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items the k documents (doc_id, text) that score highest above 0.

    Equal scores go by ascending doc_id, null last. Each row of documents is a document and each row of items an item,
    so repeated rows rank as often as they stand. A null or empty text has no terms and finds or is found by
    nothing. Other columns are ignored. Items whose texts exceed VOCABULARY_BYTES are taken in rounds, each
    of which reads the documents anew.
    """
    texts = items.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    load = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    rounds = 1 + load // VOCABULARY_BYTES
    if rounds == 1:
        return _ranked(documents, texts, k)
    dealt = written(texts.withColumn("round", F.pmod(F.xxhash64("text", "item_id"), F.lit(rounds))))
    found = [written(_ranked(documents, dealt.where(F.col("round") == r), k)) for r in range(rounds)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _ranked(documents: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    spark = documents.sparkSession
    kind = texts.schema["item_id"].dataType
    rows = texts.select("item_id", "text").toArrow()
    raw = byte_texts(rows.column("text"))
    vocabulary = {t: i for i, t in enumerate(sorted({t for text in raw for t in terms_of(text)}))}
    size = len(vocabulary)

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = written(source.mapInArrow(_count_terms(vocabulary), "doc_id long, n long, terms array<int>, times array<int>"))
    sums = counted.mapInArrow(_frequencies(size), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    known = {r["term"]: r["df"] for r in sums}
    filled, total = known.pop(-1, 0), known.pop(-2, 0)
    df = np.zeros(size, np.int64)
    df[list(known)] = list(known.values())
    weight = np.floor(1000 * np.log((2 * filled + 2) / (2 * df + 1))).astype(np.int64)

    tiles = [(t.items, t.terms, exact_slices(t.times * weight[t.terms])) for t in item_tiles(raw, vocabulary, df)]
    found = counted.where("n > 0").mapInArrow(
        _multiply(tiles, size, len(raw), k, filled, max(1, total)), "item long, doc_id long, score long"
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = pa.table({"item": pa.array(range(len(raw)), pa.int64()), "item_id": rows.column("item_id")})
    named = spark.createDataFrame(names).withColumn("item_id", F.col("item_id").cast(kind))
    return ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
