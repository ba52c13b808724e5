"""Removal of passages that occur more than once, by fixed-block anchors.

Each text's blocks, side by side, are the index; every rolling window of a block's length probes it. A repeat as long
as a window holds a whole block of each of its occurrences, so both are hit there. Around the hits, windows of
the full length are counted over all texts: runs of windows that occur again are the maximal repeats. Hashes
travel packed, many to a row, in buckets; no pair of places is ever formed, so a passage that
stands in every text costs one hash for each place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortgrid.llm.common import Hasher, byte_texts, mix, small, text_key, written

BUCKET_BYTES = 64 << 20  # of text whose hashes go to one bucket, about
SPARE_BITS = 12  # of a probe's hash beyond what tells all words of the corpus apart
CHECK = np.uint64(0x2545F4914F6CDD1D)  # salt of the words in a window's second hash
CHUNK = 1 << 16  # windows that travel together, unless one text has more
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
ROWS = "bucket int, chunk string, marked int, hashes binary, places binary, docs array<struct<row:long,d1:long,d2:long,begin:long>>"


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up, self.down = (
                np.concatenate([p, p * np.uint64(pow(b, size, 1 << 64))])
                for p, b in ((self.up, BASE), (self.down, pow(BASE, -1, 1 << 64)))
            )
        return self.up[:n], self.down[:n]


def window_hashes(words: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Hash of each run of width words; equal runs have equal hashes wherever they stand."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    up, down = powers.get(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)])
    return mix((sums[width:] - sums[:-width]) * down[: len(words) - width + 1])


def _pack(hashes: np.ndarray, size: int) -> bytes:
    """size bytes of each hash; 16 of rows of two."""
    if hashes.ndim == 2:
        return np.ascontiguousarray(hashes).tobytes()
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpack(packed: bytes, size: int) -> np.ndarray:
    flat = np.frombuffer(packed, np.uint8).reshape(-1, size)
    out = np.zeros((len(flat), 8), np.uint8)
    out[:, :size] = flat
    return out.view(np.uint64).ravel()


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


class Chunk:
    """Windows of some texts, put out as one row a bucket and one row that tells the texts."""

    schema = pa.schema(
        [("bucket", pa.int32()), ("chunk", pa.string()), ("marked", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary())]
        + [("docs", pa.list_(pa.struct([(c, pa.int64()) for c in ("row", "d1", "d2", "begin")])))]
    )

    def __init__(self, buckets: int, size: int):
        self.buckets, self.size = buckets, size
        self.clear()

    def clear(self):
        self.docs, self.hashes, self.places, self.marks, self.end = [], [], [], [], 0

    def add(self, row: int, d1: int, d2: int, length: int, hashes: np.ndarray, starts: np.ndarray, marks: np.ndarray):
        """length: the places that the text takes up; starts: where in it the hashes stand."""
        self.docs.append({"row": row, "d1": d1, "d2": d2, "begin": self.end})
        self.hashes.append(hashes)
        self.places.append(starts + self.end)
        self.marks.append(marks)
        self.end += length

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        name = hashlib.md5(repr(self.docs).encode()).hexdigest()
        hashes, places, marks = map(np.concatenate, (self.hashes, self.places, self.marks))
        bucket = _bucket_of(hashes if hashes.ndim == 1 else hashes[:, 0], self.buckets)
        order = np.argsort(bucket * 2 + ~marks, kind="stable")
        hashes, bucket, marks = hashes[order], bucket[order], marks[order]
        places = places[order].astype(np.uint16 if self.end <= 1 << 16 else np.uint32)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]
        if not len(bucket):
            starts = ends = []
        out = [
            {
                "bucket": int(bucket[a]), "chunk": name, "marked": int(marks[a:b].sum()),
                "hashes": _pack(hashes[a:b], self.size), "places": places[a:b].tobytes(), "docs": None,
            }
            for a, b in zip(starts, ends)
        ]
        out.append({"bucket": int(name[:8], 16) % self.buckets, "chunk": name, "marked": 0, "hashes": None, "places": None, "docs": self.docs})
        yield pa.RecordBatch.from_pylist(out, self.schema)
        self.clear()


def _probe(block: int, window: int, buckets: int, size: int):
    """Rolling block hashes of the texts of at least a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, powers, chunk = Hasher(), Powers(), Chunk(buckets, size)
        for batch in batches:
            d1, d2 = (batch.column(c).to_pylist() for c in ("d1", "d2"))
            for i, text in enumerate(byte_texts(batch.column("text"))):
                words = hasher.array(text.split())
                if len(words) < window:
                    continue
                hashes = window_hashes(words, block, powers)
                if chunk.end and chunk.end + len(hashes) > CHUNK:
                    yield from chunk.rows()
                at = np.arange(len(hashes))
                chunk.add(0, d1[i], d2[i], len(hashes), hashes, at, at % block == 0)
        yield from chunk.rows()

    return run


def _equal_rows(pairs: np.ndarray) -> np.ndarray:
    """Which rows of two numbers stand more than once."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    same = (pairs[order[1:]] == pairs[order[:-1]]).all(axis=1)
    met = np.zeros(len(pairs), bool)
    met[order[1:]] |= same
    met[order[:-1]] |= same
    return met


def _again(size: int, indexed: bool):
    """Of a bucket's hashes, the places of those that stand elsewhere too. indexed: and equal a marked one, by the
    bytes that travel; else by both hashes of a window."""

    def run(table: pa.Table) -> pa.Table:
        meta = table.filter(table.column("hashes").is_null())
        data = table.filter(table.column("hashes").is_valid())
        packed, marked = data.column("hashes").to_pylist(), data.column("marked").to_pylist()
        counts = [len(p) // size for p in packed]
        ends = np.cumsum([0, *counts])
        if indexed:
            hashes = _unpack(b"".join(packed), size)
            heads = [hashes[a : a + m] for a, m in zip(ends, marked)]
            index = np.unique(np.concatenate(heads)) if heads else hashes
            slot = np.searchsorted(index, hashes)
            slot[slot == len(index)] = 0
            met = index[slot] == hashes if len(index) else np.zeros(len(hashes), bool)
            seen = np.bincount(slot[met], minlength=max(len(index), 1))
            met &= seen[slot] > 1
        else:
            met = _equal_rows(np.frombuffer(b"".join(packed), np.uint64).reshape(-1, 2))
        found = []
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            keep = met[a:b]
            if keep.any():
                places = data.column("places")[k].as_py()
                kind = np.uint16 if len(places) == 2 * (b - a) else np.uint32
                found.append((data.column("chunk")[k].as_py(), np.frombuffer(places, kind)[keep].astype(np.uint32).tobytes()))
        out = pa.table(
            {"chunk": pa.array([c for c, _ in found], pa.string()), "places": pa.array([p for _, p in found], pa.binary())}
        ).append_column("docs", pa.nulls(len(found), Chunk.schema.field("docs").type))
        return pa.concat_tables([out, meta.select(["chunk", "places", "docs"])])

    return run


def _per_text(table: pa.Table) -> pa.Table:
    """The places found in a chunk, dealt to its texts."""
    docs = [d for x in table.column("docs").to_pylist() if x for d in x]
    found = [p for p in table.column("places").to_pylist() if p]
    rows = {"row": [], "d1": [], "d2": [], "places": []}
    if found:
        if not docs:
            raise RuntimeError("places of a chunk whose texts are unknown: the input rows were read in another order")
        places = np.unique(np.concatenate([np.frombuffer(p, np.uint32) for p in found])).astype(np.int64)
        begins = np.array([d["begin"] for d in docs] + [1 << 40])
        cuts = np.searchsorted(places, begins)
        for d, a, b in zip(docs, cuts, cuts[1:]):
            if b > a:
                for c in ("row", "d1", "d2"):
                    rows[c].append(d[c])
                rows["places"].append((places[a:b] - d["begin"]).astype(np.uint32).tobytes())
    return pa.table(
        [pa.array(rows[c], pa.int64()) for c in ("row", "d1", "d2")] + [pa.array(rows["places"], pa.binary())],
        ["row", "d1", "d2", "places"],
    )


def _extend(block: int, window: int, buckets: int):
    """Hashes of the full windows that hold a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, powers, chunk = Hasher(), Powers(), Chunk(buckets, 16)
        for batch in batches:
            d1, d2, hits = (batch.column(c).to_pylist() for c in ("d1", "d2", "places"))
            for i, text in enumerate(byte_texts(batch.column("text"))):
                words = hasher.array(text.split())
                hashes = np.stack([window_hashes(w, window, powers) for w in (words, mix(words ^ CHECK))], axis=1)
                hit = np.frombuffer(hits[i], np.uint32).astype(np.int64)
                step = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(step, np.clip(hit - (window - block), 0, len(hashes)), 1)
                np.add.at(step, np.clip(hit + 1, 0, len(hashes)), -1)
                starts = np.flatnonzero(np.cumsum(step)[:-1] > 0)
                if chunk.end and chunk.end + len(hashes) > CHUNK:
                    yield from chunk.rows()
                chunk.add(0, d1[i], d2[i], len(hashes), hashes[starts], starts, np.zeros(len(starts), bool))
        yield from chunk.rows()

    return run


def _cut(window: int):
    """Texts without the words that the windows at places cover, and how many words went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, places in zip(byte_texts(batch.column("text")), batch.column("places").to_pylist()):
                words = text.split()
                step = np.zeros(len(words) + 1, np.int64)
                starts = np.frombuffer(places, np.uint32).astype(np.int64)
                step[starts] += 1
                np.add.at(step, starts + window, -1)
                gone = np.cumsum(step)[:-1] > 0
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g))
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("d1"), batch.column("d2"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["d1", "d2", "n_removed", "kept"],
            )

    return run


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [t.split() for t in byte_texts(batch.column("text"))]
        whole = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
        columns = [batch.column(c) for c in ("doc_id", "d1", "d2")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(list(map(len, words)), pa.int64()), pa.array(whole)], ["doc_id", "d1", "d2", "n_words", "whole_sha256"]
        )


def _keyed(documents: DataFrame) -> DataFrame:
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.withColumns(text_key(F.col("text")))


def repeated_windows(documents: DataFrame, window: int = 35) -> DataFrame:
    """(d1, d2, places): of the texts with these digests, the words at which a window starts that stands elsewhere too."""
    block = (window + 1) // 2  # any window holds a whole block, wherever it starts
    spark = documents.sparkSession
    load = documents.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-load // BUCKET_BYTES))
    size = min(8, max(5, -(-(load.bit_length() + SPARE_BITS - 2) // 8)))  # a word has some four bytes or more
    found = "chunk string, places binary, docs array<struct<row:long,d1:long,d2:long,begin:long>>"
    by_text = "row long, d1 long, d2 long, places binary"

    texts = _keyed(documents).select("d1", "d2", "text")
    probes = texts.mapInArrow(_probe(block, window, buckets, size), ROWS)
    hits = probes.groupBy("bucket").applyInArrow(_again(size, True), found)
    hits = written(hits.groupBy("chunk").applyInArrow(_per_text, by_text).groupBy("d1", "d2").agg(F.first("places").alias("places")))

    keys = hits.select("d1", "d2")
    hit_texts = texts.join(F.broadcast(keys) if small(keys) else keys, ["d1", "d2"], "left_semi")
    wide = hit_texts.join(hits, ["d1", "d2"]).mapInArrow(_extend(block, window, buckets), ROWS)
    repeats = written(wide.groupBy("bucket").applyInArrow(_again(16, False), found))
    repeats = repeats.groupBy("chunk").applyInArrow(_per_text, by_text)
    return written(repeats.groupBy("d1", "d2").agg(F.first("places").alias("places")))


def without_repeats(documents: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, whole_sha256), a row for each document.

    Words are what ASCII white space separates. A word goes if a window of so many words covers it whose words also
    start anywhere else, in this text or another; windows are judged on the input. kept: the other words, joined
    by one space; null where none went, whole_sha256 being the digest of all words so joined. Null is an empty text;
    texts shorter than a window lose nothing; equal rows repeat each other. Other columns are ignored.
    """
    texts = _keyed(documents)
    kind = documents.schema["doc_id"].dataType.simpleString()
    counted = texts.mapInArrow(_count, f"doc_id {kind}, d1 long, d2 long, n_words long, whole_sha256 string")
    repeats = repeated_windows(documents, window)
    keys = repeats.select("d1", "d2")
    shorter = texts.select("d1", "d2", "text").join(F.broadcast(keys) if small(keys) else keys, ["d1", "d2"], "left_semi")
    shorter = shorter.groupBy("d1", "d2").agg(F.first("text").alias("text")).join(repeats, ["d1", "d2"])
    shorter = shorter.mapInArrow(_cut(window), "d1 long, d2 long, n_removed long, kept string")
    return counted.join(shorter, ["d1", "d2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), "kept", "whole_sha256"
    )
