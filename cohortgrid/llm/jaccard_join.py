"""Join of documents on the Jaccard similarity of their word shingles, without a missed link.

Sizes fall into bands. Two linked sets differ in at most D shingles, D known per band; so of D + 1 ranges of the hash
space at least one holds the same shingles in both. A tile is a band, a range and its content: only documents that
share a tile can link. Small sets would leave ranges empty and meet in tiles of nothing; a pair with one of at most
small_size() shingles meets by deletion instead: the common subset of a linked pair is either set without a few
shingles, so each drops every choice of so many. In a tile, hashed bitmaps bound the overlap from above by their bit counts, and what
passes is settled by intersecting sorted arrays. Tiles first link each set to one partner; pairs that these
links already connect are not looked at again, so a group of copies costs a star and not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortgrid.llm.common import Hasher, byte_texts, keep_ids, list_column, mix, signed, slices, sorted_groups, written
from cohortgrid.llm.graph import components

BAND_RATIO = 1.5
BLOCK = 128  # members of a tile that are compared at once
ROWS = 512  # rows whose sets are in memory at once
DELETIONS = 128  # keys of a set by deletion at most
KEY_BITS = np.uint64((1 << 48) - 1)  # of a tile's key: shorter ones travel lighter
SEEN = 200_000  # sets of which a task remembers that it has met them


def shingle_set(text: bytes, hasher: Hasher, ngram: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; of the whole sequence if it is shorter; empty without words."""
    words = hasher.array(text.lower().split())  # bytes: A-Z only, ASCII white space only
    if not len(words):
        return words
    width = min(ngram, len(words))
    total = np.full(len(words) - width + 1, np.uint64(width), np.uint64)
    for j in range(width):
        total += words[j : len(words) - width + 1 + j] * np.uint64(2 * (j + 1) * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1)
    return np.unique(mix(total))


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    return tuple(
        int(mix(hashes ^ np.uint64(salt)).sum(dtype=np.uint64)) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)
    )


@lru_cache(65536)
def band_of(size: int) -> tuple[int, int, int]:
    """(number, smallest, largest size) of the band that holds size."""
    number, low = 0, 1
    while True:
        high = max(low, int(np.ceil(low * BAND_RATIO)) - 1)
        if size <= high:
            return number, low, high
        number, low = number + 1, high + 1


@lru_cache(256)
def _edges(ranges: int) -> np.ndarray:
    return np.array([-(-(j << 64) // ranges) for j in range(1, ranges)], np.uint64)


@lru_cache(64)
def small_size(num: int, den: int) -> int:
    """The largest size of which each set that may link with one of it has DELETIONS keys or fewer."""

    def keys(size: int, small: int) -> int:
        return sum(comb(size, k) for k in range(size - -(-size * num // den) + 1) if size - k <= small)

    small = 0
    while small < 64 and all(keys(n, small + 1) <= DELETIONS for n in range(1, (small + 1) * den // num + 1)):
        small += 1
    return small


def deletion_keys(hashes: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """A key for each subset of the set that may be all it shares with a linked one, if one of the two is small."""
    size, small = len(hashes), small_size(num, den)
    mixed = mix(hashes ^ np.uint64(0x2545F4914F6CDD1D))
    whole, keys = mixed.sum(dtype=np.uint64), []
    for dropped in range(size - -(-size * num // den) + 1):
        if size - dropped <= small:
            out = np.array(list(combinations(range(size), dropped)), np.int64).reshape(comb(size, dropped), dropped)
            keys.append(mix(whole - mixed[out].sum(axis=1, dtype=np.uint64)))
    return keys


def tile_keys(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the tiles a set belongs to, for links at Jaccard num / den or more; two sets with one key by chance are
    compared for nothing."""
    size, small = len(hashes), small_size(num, den)
    keys = deletion_keys(hashes, num, den) if size <= small * den // num else []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)])
    at, last = size, size * den // num if size > small else 0
    while at <= last:
        number, _, high = band_of(at)
        differ = 2 * high * (den - num) // (den + num)
        if differ:  # else equal sets only, which meet by their set key
            spare = 2 + differ // 64 if high >= 64 else 6  # more ranges that agree: fewer sets whose agreeing ones are empty
            ranges = differ + 1 + spare
            ends = np.concatenate([[0], np.searchsorted(hashes, _edges(ranges)), [size]])
            content = sums[ends[1:]] - sums[ends[:-1]]
            content += np.arange(ranges, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number << 32)
            empty = ends[1:] == ends[:-1]
            # All but `most` ranges agree with a partner's, size for size; if fewer are empty here, one with content does.
            most = (size + min(high, last)) * (den - num) // (den + num)
            keys.append(mix(content[~empty] if empty.sum() < ranges - most else content))
        at = high + 1
    return np.unique(np.concatenate(keys) & KEY_BITS) if keys else np.empty(0, np.uint64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A power of two of bits, 4 a shingle or more; bit positions are the hashes' low bits."""
    bits = max(64, 1 << int(4 * len(hashes) - 1).bit_length())
    set_bits = np.zeros(bits, np.uint8)
    set_bits[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(set_bits, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, length: int) -> np.ndarray:
    """The bitmap that a shorter one of length words would be."""
    while len(words) > length:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def may_link(a: np.ndarray, na: int, b: np.ndarray, nb: int, num: int, den: int) -> bool:
    """Whether the bit counts leave room for a link: each bit of one set only costs it a shingle at least."""
    length = min(len(a), len(b))
    a, b = fold(a, length), fold(b, length)
    room = min(na - int(np.bitwise_count(a & ~b).sum()), nb - int(np.bitwise_count(b & ~a).sum()))
    return room * (num + den) >= num * (na + nb)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Exact: sorted arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * (num + den) >= num * (len(a) + len(b))


def _sizes(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, ROWS):
            sets = [shingle_set(t, hasher, ngram) for t in byte_texts(batch.column("text"))]
            keys = np.array([set_key(s) for s in sets], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(map(len, sets)), pa.int64())]
                + [pa.array(signed(keys[:, i]), pa.int64()) for i in (0, 1)],
                ["doc_id", "n", "k1", "k2"],
            )

    return run


def _tiles(ngram: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(), set()
        for batch in slices(batches, ROWS):
            ids, keys = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text"))):
                hashes = shingle_set(text, hasher, ngram)
                if not len(hashes) or doc_id is None or (key := set_key(hashes)) in seen:
                    continue  # a copy: the set key links it
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                ids.append(doc_id)
                keys.append(tile_keys(hashes, num, den))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), list_column(keys)], ["doc_id", "keys"])

    return run


def _bitmaps(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, ROWS):
            sets = [shingle_set(t, hasher, ngram) for t in byte_texts(batch.column("text"))]
            sizes, bits = pa.array(list(map(len, sets)), pa.int64()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, bits], ["doc_id", "n", "bits"])

    return run


def _arrays(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, ROWS):
            sets = [shingle_set(t, hasher, ngram).tobytes() for t in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "hashes"])

    return run


def _bound(num: int, den: int):
    """Of candidate pairs with both sizes and bitmaps, those that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            bits = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("xb", "yb")]
            sizes = [batch.column(c).to_pylist() for c in ("xn", "yn")]
            keep = [may_link(xb, xn, yb, yn, num, den) for xb, xn, yb, yn in zip(bits[0], sizes[0], bits[1], sizes[1])]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _settle(num: int, den: int):
    """Of pairs with both arrays, those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            sides = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("xs", "ys")]
            keep = [linked(xs, ys, num, den) for xs, ys in zip(*sides)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compare(num: int, den: int):
    """Pairs of a tile that the bitmaps can't rule out, of different groups; rows (key, left, right, side, ...) sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in sorted_groups(batches, ["key", "left", "right"]):
            node, group, n, block = (tile.column(c).to_numpy() for c in ("node", "group", "n", "block"))
            bits = [np.frombuffer(x, np.uint64) for x in tile.column("bits").to_pylist()]
            one = tile.column("left")[0].as_py() == tile.column("right")[0].as_py()
            shortest = min(map(len, bits))
            matrix = np.stack([fold(b, shortest) for b in bits])
            a, b = [], []
            for i in np.flatnonzero(block == tile.column("left")[0].as_py()):
                others = np.flatnonzero((block == tile.column("right")[0].as_py()) & (group != group[i]))
                if one:
                    others = others[others > i]
                mine, theirs = matrix[i], matrix[others]
                room = np.minimum(
                    n[i] - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64),
                    n[others] - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64),
                )
                found = others[room * (num + den) >= num * (n[i] + n[others])]
                a += [node[i]] * len(found)
                b += node[found].tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def similar_components(documents: DataFrame, ngram: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each document.

    Words are what ASCII white space separates, A-Z in lower case. Documents link at Jaccard num / den or more;
    component_id is the smallest doc_id that links reach. A null or empty text has the empty set and stays alone.
    Rows that share a doc_id are one document to the links; each keeps its own n_shingles. A null doc_id
    links to nothing and has a null component. Other columns are ignored.
    """
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = written(source.mapInArrow(_sizes(ngram), "doc_id long, n long, k1 long, k2 long"))

    # Equal sets: one of them, the first, stands for all.
    known = base.where("n > 0 AND doc_id IS NOT NULL")
    firsts = known.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = written(firsts.where("first < last"))  # written: the join may then split a group of many copies
    copies = written(
        known.join(firsts, ["n", "k1", "k2"])
        .where("doc_id <> first")
        .select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
        .distinct()
    )

    tiles = source.mapInArrow(_tiles(ngram, num, den), "doc_id long, keys array<long>")
    members = tiles.select("doc_id", F.explode("keys").alias("key"))
    whole = Window.partitionBy("key")
    members = members.withColumns({"low": F.min("doc_id").over(whole), "high": F.max("doc_id").over(whole)})
    members = written(members.where("low < high").select("key", "doc_id"))
    first_of = copies.select(F.col("a").alias("doc_id"), F.col("b").alias("first"))
    nodes = (
        members.join(first_of, "doc_id", "left")
        .select("key", F.coalesce("first", "doc_id").alias("node"))
        .distinct()
    )
    nodes = nodes.withColumn("low", F.min("node").over(whole))
    members = written(nodes)

    # A star in each tile, and of a set's stars the one it shares most tiles with.
    partners = members.where("node <> low").groupBy("node", "low").agg(F.count("*").alias("tiles"))
    stars = partners.groupBy("node").agg(F.max_by("low", F.struct("tiles", -F.col("low"))).alias("low"))
    stars = written(stars.select(F.col("node").alias("a"), F.col("low").alias("b")))

    wanted = stars.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(
        members.where("node <> low").select(F.col("node").alias("doc_id"))
    )
    sets = written(
        keep_ids(source, written(wanted.distinct()), "doc_id")
        .mapInArrow(_bitmaps(ngram), "doc_id long, n long, bits binary")
    )

    def with_sides(pairs: DataFrame, of: DataFrame, **columns: str) -> DataFrame:
        for name, tag in (("a", "x"), ("b", "y")):
            side = [F.col(column).alias(f"{tag}{short}") for short, column in columns.items()]
            pairs = pairs.join(of.select(F.col("doc_id").alias(name), *side), name)
        return pairs.select("a", "b", *[f"{tag}{short}" for tag in "xy" for short in columns])

    def settled(pairs: DataFrame) -> DataFrame:
        """Bounded by bitmaps first: only the sets of pairs that these leave travel whole."""
        pairs = written(with_sides(pairs, sets, n="n", b="bits").mapInArrow(_bound(num, den), "a long, b long"))
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        arrays = keep_ids(source, ids, "doc_id").mapInArrow(_arrays(ngram), "doc_id long, hashes binary")
        return with_sides(pairs, arrays, s="hashes").mapInArrow(_settle(num, den), "a long, b long")

    links = written(settled(stars).unionByName(copies))
    groups = components(links)

    # What the stars left apart: tiles that hold several groups, cut into blocks.
    named = members.select("key", "node").join(groups, "node", "left")
    named = named.select("key", "node", F.coalesce("component", "node").alias("group"))
    named = named.withColumns(
        {"low": F.min("group").over(whole), "high": F.max("group").over(whole), "size": F.count("*").over(whole)}
    )
    apart = named.where("low < high").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    apart = apart.select("key", "node", "group", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    bits = sets.select(F.col("doc_id").alias("node"), "n", "bits")
    laid = apart.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "node", "group"
    )
    laid = laid.join(bits, "node").repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    pairs = laid.select("key", "left", "right", "block", "node", "group", "n", "bits").mapInArrow(
        _compare(num, den), "a long, b long"
    )
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    more = settled(pairs)
    groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    return base.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
