"""Spelling variants: words of the corpus that differ by one letter, and the form that most of them stand for.

One edit changes a word's letter counts by at most two: a replaced letter takes one and adds one, a deleted letter
takes one. So words are points in the space of letter counts. For each length a k-d tree, built on a bounded sample of
the words, cuts that space into cells; every word lies in one cell and asks all cells, of its own length and of one
letter less, whose boxes it can reach. A task holds the words of one cell in a k-d tree of its own, follows only
branches whose boxes are in reach, and verifies the order of the letters: the one edit that turns the counts of a word
into those of another is made at each place of its letter, and the result is looked up by its hash, then compared.
No pairs of a cell or of words with equal counts are formed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortgrid.cluster import task_count
from cohortgrid.llm.common import mix, slices, written

LETTERS = bytes([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])  # of a lower-cased word, in Latin-1
TEXTS = 512  # texts in memory at once
HELD = 500_000  # words that a task counts before it hands them on
CELL = 200_000  # letters of the words of a cell, about; a cell that holds more is split by the words' hashes
ASKED = 16  # times as many letters may ask a cell before its askers are split, too
SAMPLED = 64  # words of the sample for each cell
CELLS = 16_384  # of the sampled trees at most; beyond that cells only split by hashes
LONGEST = 64  # letters; longer words are not sampled: a length of theirs is one cell, split by hashes
LEAF = 32  # points in a leaf of a task's own tree
BLOCK = 1 << 20  # comparisons or candidates at once

DIM = np.full(256, -1)
DIM[np.frombuffer(LETTERS, np.uint8)] = np.arange(len(LETTERS))
WEIGHT = mix(np.arange(1, 257, dtype=np.uint64))  # of a letter in a word's hash
BASE = 0x9E3779B97F4A7C15  # odd: has an inverse
INVERSE = np.uint64(pow(BASE, -1, 1 << 64))


# Words


def _count_words(least: int, slip: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall
        counts: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            words = pa.array([w.encode("latin-1") for w in counts], pa.binary())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches, TEXTS):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                seed = zlib.crc32(f"{doc_id or ''}:".encode())
                for word in find(text.encode().lower().decode()):  # bytes: A-Z only
                    if slip:
                        drawn = zlib.crc32(word.encode(), seed)
                        if not drawn % slip:
                            at = drawn % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                    counts[word] = counts.get(word, 0) + 1
            if len(counts) >= HELD:
                yield out()
                counts.clear()
        yield out()

    return run


def corpus_words(documents: DataFrame, least_letters: int = 7, least_count: int = 2, slip: int = 0) -> DataFrame:
    """(word binary, n): words of so many letters and occurrences, in Latin-1, which keeps the order of code points.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. With a slip, an occurrence whose
    crc32 of "<doc_id>:<word>" it divides loses the letter at that number modulo its length. A null text has no words, a
    null doc_id counts as an empty one, repeated rows count as often as they stand. Other columns are ignored.
    """
    texts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counted = texts.mapInArrow(_count_words(least_letters, slip), "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# Letter counts and trees over them


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Rows of letters (words x length) -> rows of counts (words x letters)."""
    at = DIM[codes] + len(LETTERS) * np.arange(len(codes))[:, None]
    counts = np.bincount(at.ravel(), minlength=len(LETTERS) * len(codes))
    return counts.reshape(len(codes), len(LETTERS)).astype(np.int16 if codes.shape[1] < 1 << 15 else np.int32)


def matrix_of(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of letters."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def halves(points: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """(letter, count, which points have at most that count): the most even cut; None if all points are equal."""
    cuts = np.floor(points.mean(axis=0))
    below = points <= cuts
    share = below.sum(axis=0)
    letter = int(np.argmin(np.abs(2 * share - len(points))))
    if share[letter] in (0, len(points)):
        return None
    return letter, int(cuts[letter]), below[:, letter]


def grow(points: np.ndarray, largest: int, leaves: list) -> tuple | int:
    """A tree (letter, count, tree up to that count, tree above), or the number of a leaf of at most so many points.

    leaves gets the row numbers of the points of each leaf, in order.
    """

    def node(rows: np.ndarray):
        cut = halves(points[rows]) if len(rows) > largest else None
        if cut is None:
            leaves.append(rows)
            return len(leaves) - 1
        letter, count, below = cut
        return letter, count, node(rows[below]), node(rows[~below])

    return node(np.arange(len(points)))


def place(tree: tuple | int, points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    out = np.empty(len(points), np.int64)
    stack = [(tree, np.arange(len(points)))]
    while stack:
        node, rows = stack.pop()
        if not len(rows):
            continue
        if not isinstance(node, tuple):
            out[rows] = node
            continue
        letter, count, low, high = node
        below = points[rows, letter] <= count
        stack += [(low, rows[below]), (high, rows[~below])]
    return out


def reach(tree: tuple | int, points: np.ndarray, more: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows of points): where points may lie that lack one letter of these and have up to `more` others.

    Along a path the box changes in one letter at a time, so the two distances of a point to the box do as well.
    """
    zero = np.zeros(len(points), np.int64)
    stack = [(tree, np.arange(len(points)), zero, zero, {}, {})]
    while stack:
        node, rows, up, down, lows, highs = stack.pop()
        if not isinstance(node, tuple):
            yield node, rows
            continue
        letter, count, low, high = node
        mine = points[rows, letter].astype(np.int64)
        gone = down + np.maximum(mine - count, 0)
        if letter in highs:
            gone -= np.maximum(mine - highs[letter], 0)
        keep = np.flatnonzero(gone <= 1)
        if len(keep):
            stack.append((low, rows[keep], up[keep], gone[keep], lows, highs | {letter: count}))
        new = up + np.maximum(count + 1 - mine, 0)
        if letter in lows:
            new -= np.maximum(lows[letter] - mine, 0)
        keep = np.flatnonzero(new <= more)
        if len(keep):
            stack.append((high, rows[keep], new[keep], down[keep], lows | {letter: count + 1}, highs))


def signatures(counts: np.ndarray) -> np.ndarray:
    """64 bits of which one letter more or less changes one at most: two levels of a to z, the others folded."""
    bits = np.zeros((len(counts), 64), np.uint8)
    bits[:, :26] = counts[:, :26] >= 1
    bits[:, 26:52] = counts[:, :26] >= 2
    for i in range(26, counts.shape[1]):
        bits[:, 52 + i % 12] |= counts[:, i] >= 1
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within the owner) of so many things an owner."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def pieces(weights: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices whose weights sum to at most limit, or of one thing."""
    ends = np.cumsum(weights)
    at = 0
    while at < len(weights):
        stop = int(np.searchsorted(ends, limit + (ends[at - 1] if at else 0), "right"))
        stop = max(stop, at + 1)
        yield slice(at, stop)
        at = stop


class Points:
    """Words of one length: letters, hashes, and their distinct letter counts."""

    def __init__(self, words: list[bytes]):
        self.codes = matrix_of(words)
        length = self.codes.shape[1]
        self.counts = letter_counts(self.codes)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(length, BASE, np.uint64))
            self.before = np.zeros((len(words), length + 1), np.uint64)
            np.cumsum(WEIGHT[self.codes] * self.powers, axis=1, dtype=np.uint64, out=self.before[:, 1:])
            keys = WEIGHT[self.codes].sum(axis=1, dtype=np.uint64)
        _, first, of = np.unique(keys, return_index=True, return_inverse=True)
        if (self.counts[first[of]] != self.counts).any():  # two vectors with one key
            _, first, of = np.unique(self.counts, axis=0, return_index=True, return_inverse=True)
        self.of = of.ravel()
        self.vectors = self.counts[first]
        self.sizes = np.bincount(self.of, minlength=len(first))
        self.members = np.argsort(self.of, kind="stable")
        self.starts = np.cumsum(self.sizes) - self.sizes

    @property
    def hashes(self) -> np.ndarray:
        return self.before[:, -1]

    @cached_property
    def places(self) -> np.ndarray:
        """For each word its places, those of one letter together, in the order of letters."""
        return np.argsort(DIM[self.codes], axis=1, kind="stable")

    @cached_property
    def ends(self) -> np.ndarray:
        """For each word and letter the end of the letter's places."""
        return self.counts.cumsum(axis=1, dtype=np.int64)


class Cell:
    """The words of a cell, in order, with their counts n; finds the near ones of other words."""

    def __init__(self, words: list[bytes], n: list[int]):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words = [words[i] for i in order]
        self.n = np.array(n, np.int64)[order]
        self.points = Points(self.words)
        leaves: list[np.ndarray] = []
        self.tree = grow(self.points.vectors, LEAF, leaves)
        self.leaves = leaves
        self.marks = signatures(self.points.vectors)
        self.by_hash = np.argsort(self.points.hashes, kind="stable")
        self.sorted_hashes = self.points.hashes[self.by_hash]

    def near(self, asked: Points) -> tuple[np.ndarray, np.ndarray]:
        """(row of asked, row of this cell) of words that differ by one edit.

        Of two words of a length, the one with the later of the two replaced letters asks.
        """
        more = int(asked.codes.shape[1] == self.points.codes.shape[1])
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2]
        for from_vectors, to_vectors in self._reached(asked, more):
            change = self.points.vectors[to_vectors] - asked.vectors[from_vectors]
            right = (np.abs(change).sum(axis=1) == 1 + more) & (change.min(axis=1) == -1)
            change, from_vectors = change[right], from_vectors[right]
            taken, given = change.argmin(axis=1), change.argmax(axis=1)
            if more:
                ordered = given < taken
                taken, given, from_vectors = taken[ordered], given[ordered], from_vectors[ordered]
            for part in pieces(asked.sizes[from_vectors], BLOCK):
                pair, k = spread(asked.sizes[from_vectors[part]])
                word = asked.members[asked.starts[from_vectors[part]][pair] + k]
                found += self._verified(asked, word, taken[part][pair], given[part][pair] if more else None)
        rows, mine = map(np.concatenate, zip(*found))
        both = np.unique(rows * len(self.words) + mine)  # two places of a letter may give one word
        return both // len(self.words), both % len(self.words)

    def _reached(self, asked: Points, more: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (vector of asked, vector of this cell) that boxes and signatures leave, in blocks."""
        marks = signatures(asked.vectors)
        held, size = [], 0
        for leaf, rows in reach(self.tree, asked.vectors, more):
            inside = self.leaves[leaf]
            for at in range(0, len(rows), BLOCK // LEAF):
                some = rows[at : at + BLOCK // LEAF]
                apart = np.bitwise_count(marks[some][:, None] ^ self.marks[inside][None, :])
                a, b = np.nonzero(apart <= 1 + more)
                held.append((some[a], inside[b]))
                size += len(a)
                if size >= BLOCK // 16:
                    yield tuple(map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*held)))

    def _verified(self, asked: Points, word: np.ndarray, taken: np.ndarray, given: np.ndarray | None):
        """Makes the edit at each place of the taken letter and looks the result up."""
        letters = np.frombuffer(LETTERS, np.uint8)
        for part in pieces(asked.counts[word, taken].astype(np.int64), BLOCK):
            times = asked.counts[word[part], taken[part]].astype(np.int64)
            edit, k = spread(times)
            row, letter = word[part][edit], taken[part][edit]
            at = asked.places[row, asked.ends[row, letter] - times[edit] + k]
            old = WEIGHT[letters[letter]]
            with np.errstate(over="ignore"):
                if given is None:
                    kept = asked.before[row, at]
                    rest = asked.hashes[row] - kept - old * asked.powers[at]
                    wanted = kept + rest * INVERSE
                else:
                    wanted = asked.hashes[row] + (WEIGHT[letters[given[part][edit]]] - old) * asked.powers[at]
            low = np.searchsorted(self.sorted_hashes, wanted, "left")
            hits = np.searchsorted(self.sorted_hashes, wanted, "right") - low
            candidate, k = spread(hits)
            if not len(candidate):
                continue
            row, at, mine = row[candidate], at[candidate], self.by_hash[low[candidate] + k]
            for some in pieces(np.full(len(row), asked.codes.shape[1]), BLOCK):
                edited = asked.codes[row[some]]
                if given is None:
                    columns = np.arange(edited.shape[1] - 1)
                    edited = np.take_along_axis(edited, columns + (columns >= at[some][:, None]), axis=1)
                else:
                    edited[np.arange(len(edited)), at[some]] = letters[given[part][edit[candidate[some]]]]
                same = (edited == self.points.codes[mine[some]]).all(axis=1)
                yield row[some][same], mine[some][same]


# Cells over the cluster


def sampled_trees(words: DataFrame) -> dict[int, tuple | int]:
    """Length -> tree whose leaves are numbers of cells, from a sample of about CELLS * SAMPLED words at most."""
    letters = F.octet_length("word")
    rows, load = words.agg(F.count("*"), F.sum(letters.cast("long"))).first()
    cells = min(CELLS, 1 + (load or 0) // CELL)
    share = min(1.0, cells * SAMPLED / max(1, rows))
    drawn = F.pmod(F.xxhash64(F.lit(11), "word"), F.lit(1 << 20)) < round(share * (1 << 20))
    sample = words.where(drawn & (letters <= LONGEST)).select("word").toArrow().column("word").to_pylist()
    by_length: dict[int, list[bytes]] = {}
    for word in sorted(map(bytes, sample)):
        by_length.setdefault(len(word), []).append(word)
    trees, at = {}, 0
    in_cell = max(1, round(share * rows * CELL / max(1, load or 0)))

    def numbered(node):
        return (*node[:2], *map(numbered, node[2:])) if isinstance(node, tuple) else node + at

    for length, some in sorted(by_length.items()):
        leaves: list = []
        tree = grow(letter_counts(matrix_of(some)), in_cell, leaves)
        trees[length] = numbered(tree)
        at += len(leaves)
    return trees


def _by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        yield length, np.flatnonzero(lengths == length)


def _routes(trees: dict, words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(side, rows, cells): side 0 the cell a word lies in, side 1 the cells it asks. A length without a tree is one
    cell, whose number is minus the length."""
    for length, rows in _by_length(words):
        points = letter_counts(matrix_of([words[i] for i in rows]))
        own = trees.get(length, -length)
        yield 0, rows, place(own, points)
        for tree, more in ((own, 1), (trees.get(length - 1, 1 - length), 0)):
            for cell, asking in reach(tree, points, more):
                yield 1, rows[asking], np.full(len(asking), cell)


def _loads(trees: dict):
    """Letters that lie in a cell and that ask it, summed for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads: dict[int, list[int]] = {}
        for batch in slices(batches, 1 << 14):
            words = batch.column("word").to_pylist()
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            for side, rows, cells in _routes(trees, words):
                names, of = np.unique(cells, return_inverse=True)
                for cell, load in zip(names.tolist(), np.bincount(of, sizes[rows]).astype(np.int64).tolist()):
                    loads.setdefault(cell, [0, 0])[side] += load
        columns = [list(loads), *([v[i] for v in loads.values()] for i in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cell", "inside", "asking"])

    return run


def _sent(trees: dict, parts: dict[int, tuple[int, int]]):
    """(cell, part, side, word, n): a word to the cell it lies in and to those it asks. Of a cell cut into a x b parts,
    a word lies in one of a, in all of b, and asks in all of a, in one of b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = np.array(sorted(parts), np.int64)
        shape = np.array([parts[c] for c in cut.tolist()], np.int64).reshape(-1, 2)
        for batch in slices(batches, 1 << 12):
            words = batch.column("word").to_pylist()
            drawn = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
            for side, rows, cells in _routes(trees, words):
                sizes = np.ones((len(rows), 2), np.int64)
                if len(cut):
                    at = np.minimum(np.searchsorted(cut, cells), len(cut) - 1)
                    sizes = np.where((cut[at] == cells)[:, None], shape[at], 1)
                owner, k = spread(sizes[:, 1 - side])
                mine = drawn[rows[owner]] % sizes[owner, side]
                part = mine * sizes[owner, 1] + k if side == 0 else k * sizes[owner, 1] + mine
                taken = batch.take(pa.array(rows[owner]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells[owner]), pa.array(part), pa.array(np.full(len(owner), side, np.int32)), *taken.columns],
                    ["cell", "part", "side", "word", "n"],
                )

    return run


def _best(rows: np.ndarray, others: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, number of others, the best of them: largest n, then smallest rank) of pairs."""
    order = np.lexsort((rank[others], -n[others], rows))
    rows, others = rows[order], others[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.empty(0, np.int64)
    return rows[first], np.diff(np.r_[first, len(rows)]), others[first]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, k, best_n, best) for words with near ones in a cell; rows come by cell and part, those inside first."""
    key, inside, cell = None, [], None

    def answers(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
        for _, rows in _by_length(words):
            for some in pieces(np.full(len(rows), len(words[rows[0]])), BLOCK):
                mine = [words[i] for i in rows[some]]
                n = counts[rows[some]]
                asked, near = cell.near(Points(mine))
                rank = np.empty(len(mine), np.int64)
                rank[sorted(range(len(mine)), key=mine.__getitem__)] = np.arange(len(mine))
                for a, b, of, to in ((asked, near, (mine, n), (cell.words, cell.n)), (near, asked, (cell.words, cell.n), (mine, n))):
                    row, k, best = _best(a, b, to[1], rank if to[0] is mine else np.arange(len(cell.words)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([of[0][i] for i in row], pa.binary()),
                            pa.array(k.astype(np.int64)),
                            pa.array(to[1][best]),
                            pa.array([to[0][i] for i in best], pa.binary()),
                        ],
                        ["word", "k", "best_n", "best"],
                    )

    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ("cell", "part", "side")]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            if key != (columns[0][a], columns[1][a]):
                key, inside, cell = (columns[0][a], columns[1][a]), [], None
            part = batch.slice(a, b - a)
            if columns[2][a] == 0:
                inside.append(part)
            elif inside or cell:
                if cell is None:
                    held = pa.Table.from_batches(inside)
                    cell, inside = Cell(held.column("word").to_pylist(), held.column("n").to_pylist()), []
                yield from answers(part)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): for the words (word binary, n) that have near ones, how many, and of those the one
    of largest n, the smallest among equals. words has each word once and is read several times."""
    tasks = task_count(words.sparkSession)  # the rows are few bytes but much work: spread them by number
    trees = sampled_trees(words)
    words = words.repartition(tasks, "word")
    loads = words.mapInArrow(_loads(trees), "cell long, inside long, asking long").groupBy("cell")
    loads = loads.agg(F.sum("inside").alias("inside"), F.sum("asking").alias("asking"))
    large = loads.where((F.col("inside") > 2 * CELL) | (F.col("asking") > ASKED * CELL)).collect()
    parts = {r["cell"]: (1 + r["inside"] // CELL, 1 + r["asking"] // (ASKED * CELL)) for r in large}
    sent = words.mapInArrow(_sent(trees, parts), "cell long, part long, side int, word binary, n long")
    sent = sent.repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", "side")
    pairs = sent.mapInArrow(_search, "word binary, k long, best_n long, best binary")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return pairs.groupBy("word").agg(F.sum("k").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.less")).alias("form_n"), F.col("b.best").alias("form")
    )


def variant_forms(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each of the words (word binary, n), which are unique.

    Near are words that differ by one inserted, deleted or replaced letter. A word's form is its near word of largest
    n, the smallest in code-point order among equals, if that n is `ratio` (above 1) times its own or more; else null. root
    follows the forms to the last. No words give no rows.
    """
    words = written(words.select("word", "n"))
    near = near_words(words)
    near = near.select("word", "n_near", *[F.col(c).alias(f"near_{c}") for c in ("form", "form_n")])
    joined = words.join(near, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    formed = F.col("near_form_n") >= ratio * F.col("n")
    rows = written(
        joined.select(
            "word", "n", "n_near", *[F.when(formed, F.col(f"near_{c}")).alias(c) for c in ("form", "form_n")]
        )
    )

    # n grows by the ratio along a path, so paths are short; each round doubles what is followed.
    ways = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(ways.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        ways = further.select("word", "root")
        if further.where("next IS NOT NULL").isEmpty():
            break
    text = lambda c: F.decode(c, "ISO-8859-1")
    return rows.join(ways, "word", "left").select(
        text(F.col("word")).alias("word"),
        text(F.col("form")).alias("form"),
        text(F.coalesce("root", "word")).alias("root"),
        "n",
        "n_near",
        "form_n",
    )
