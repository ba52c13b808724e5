"""Byte-level BPE: token ids of whole texts and back, long texts encoded in pieces that join exactly.

A text may be cut before white space that follows something else: no pre-token crosses there. What has no such place
is unsplit: a word of WORD letters or more, and a run of digits, marks or white space of RUN or more. It is cut in
halves down to leaves, which are encoded by themselves; those of very long texts by many tasks. Two neighbours join by encoding a window around the join anew, wider until its first and last tokens are
those that stand there already. Then each adjacent pair of tokens stood side by side in some encoding, and
a sequence of which that holds is the encoding of the whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from cohortgrid.llm.common import slices, written

#: How byte-level vocabularies of this kind cut text before merging. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

ROWS = 512  # texts whose ids are in memory at once
SPREAD = 1_000_000  # characters from which a text goes to several tasks: some tenths of a second's work
PIECE = 8_192  # characters of a piece, about
WORD = 16  # letters from which a word is encoded in halves
RUN = 4_096  # digits, marks or white space in a row that are
LEAF = 2_048  # bytes of a leaf at most; what is shorter has two leaves
MARK = regex.compile(r"[^\s\p{L}\p{N}]| ")
SAFE = regex.compile(r"(?<=[^\s])(?=[ \n])")
#: Letters and more, found fast; what it finds is looked at for words.
MAYBE_WORD = re.compile(rf"[^\W_]{{{WORD}}}")
REST = re.compile(r"[^\W_]*")
LONG_WORD = regex.compile(rf" ?\p{{L}}{{{WORD},}}+")
LONG_RUN = regex.compile(rf" ?\p{{N}}{{{RUN},}}+| ?[^\s\p{{L}}\p{{N}}]{{{RUN},}}+|\s{{{RUN},}}+")
#: What an apostrophe takes of the word behind it. Fixed value.
CONTRACTION = regex.compile(r"s|t|re|ve|m|ll|d")


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in such a vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(2)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    """The tokenizer of a byte-level BPE vocabulary file. A merge's rank is the id of what it makes."""
    with open(vocabulary, encoding="utf-8") as file:
        content = json.load(file)
    alphabet = _byte_alphabet()
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    ranks = {
        bytes(alphabet[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special
    }
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text; runs that are long get encoded as trees."""
    if not MAYBE_WORD.search(text) and (len(text) < RUN or not LONG_RUN.search(text)):
        return enc.encode(text, allowed_special="all")
    ids: list[int] = []
    for run, part in cut(enc, text):
        ids += encode_run(enc, part.encode()) if run else enc.encode(part, allowed_special="all")
    return ids


def cut(enc: tiktoken.Encoding, text: str) -> Iterator[tuple[bool, str]]:
    """(whether it is one long pre-token, text) in order: pieces whose encodings, put together, are the text's."""
    special = regex.compile("|".join(map(regex.escape, enc.special_tokens_set)) or r"(?!)")
    begin = 0
    for mark in special.finditer(text):
        yield from _cut_plain(text[begin : mark.start()])
        yield False, mark[0]
        begin = mark.end()
    yield from _cut_plain(text[begin:])


def _unsplit(text: str) -> Iterator[tuple[int, int]]:
    """(begin, end) of the long words and runs of a text in order, with a blank that belongs to them."""
    runs = [m.span() for m in LONG_RUN.finditer(text)] if len(text) >= RUN else []
    maybe = MAYBE_WORD.search(text)
    while maybe:
        begin, end = maybe.start(), REST.match(text, maybe.end()).end()
        if begin and text[begin - 1] == " ":
            begin -= 1
        for word in LONG_WORD.finditer(text, begin, end):
            while runs and runs[0][0] < word.start():
                yield runs.pop(0)
            yield word.span()
        maybe = MAYBE_WORD.search(text, end)
    yield from runs


def _cut_plain(text: str) -> Iterator[tuple[bool, str]]:
    at = 0
    for begin, end in _unsplit(text):
        # A pre-token that starts before a run reaches into it only as a contraction: an apostrophe that is no part of
        # a row of marks takes the first letters of a word.
        stop = begin
        if stop > at and text[stop - 1] == "'" and (stop - 1 == at or not MARK.match(text, stop - 2)):
            taken = CONTRACTION.match(text, stop)
            stop = taken.end() if taken else stop
        # White space before a pre-token without a blank of its own is cut before its last character.
        last = stop - 1 if stop == begin and stop > at and text[stop] != " " and text[stop - 1].isspace() else stop
        yield from _pieces(text, at, last)
        if last < stop:
            yield False, text[last:stop]
        if text[end - 1].isspace() and end < len(text):
            end -= 1  # the last white space goes with, or stands before, what follows
        yield True, text[stop:end]
        at = end
    yield from _pieces(text, at, len(text))


def _pieces(text: str, at: int, stop: int) -> Iterator[tuple[bool, str]]:
    while at < stop:
        safe = SAFE.search(text, at + PIECE, stop) if stop - at > PIECE else None
        end = safe.start() if safe else stop
        yield False, text[at:end]
        at = end


def encode_run(enc: tiktoken.Encoding, run: bytes) -> list[int]:
    """Ids of one pre-token: leaves, then neighbours joined, level by level."""
    parts = [enc._encode_single_piece(x) for x in leaves(run)]
    return join_all(enc, parts)


def leaves(run: bytes) -> list[bytes]:
    """The halves of a run, cut on down to LEAF bytes; what is left of a word behind a contraction may be one byte."""
    half = len(run) // 2
    parts = [p for p in (run[:half], run[half:]) if p]
    return [x for p in parts for x in (leaves(p) if len(p) > LEAF else [p])]


def join_all(enc: tiktoken.Encoding, parts: list[list[int]]) -> list[int]:
    while len(parts) > 1:
        parts = [join(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def join(enc: tiktoken.Encoding, left: list[int], right: list[int]) -> list[int]:
    """Ids of the bytes of left and right in one, each being the ids of its own."""
    width = 8
    while True:
        a, b = left[-width:], right[:width]
        again = enc._encode_single_piece(enc.decode_bytes(a) + enc.decode_bytes(b))
        if (len(a) == len(left) or again[:2] == a[:2]) and (len(b) == len(right) or again[-2:] == b[-2:]):
            return left[: len(left) - len(a)] + again + right[len(b) :]
        width *= 2


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _encode_whole(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in slices(batches, ROWS):
            ids = [_packed(encode_text(enc, t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _spread(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in slices(batches, ROWS):
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
                rows = []
                for tree, (is_run, part) in enumerate(cut(enc, text)):
                    rows += [(tree, x) for x in (leaves(part.encode()) if is_run else [part.encode()])]
                trees, parts = zip(*rows)
                size = [len(parts)] * len(parts)
                single = np.bincount(trees)[list(trees)] == 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(trees, pa.int32())]
                    + [pa.array(single), pa.array(parts, pa.binary()), pa.array(size, pa.int32())],
                    ["digest", "place", "tree", "single", "part", "parts"],
                )

    return run


def _encode_parts(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in slices(batches, ROWS):
            ids = [
                _packed(encode_text(enc, part.decode()) if single else enc._encode_single_piece(part))
                for single, part in zip(batch.column("single").to_pylist(), batch.column("part").to_pylist())
            ]
            kept = [batch.column(c) for c in ("digest", "place", "tree", "parts")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.binary())], ["digest", "place", "tree", "parts", "ids"])

    return run


def _join_parts(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in slices(batches, ROWS):
            joined = []
            for parts in batch.column("pieces").to_pylist():
                trees: dict[int, list[list[int]]] = {}
                for p in sorted(parts, key=lambda p: p["place"]):
                    trees.setdefault(p["tree"], []).append(np.frombuffer(p["ids"], "<u4").tolist())
                joined.append(_packed([i for t in trees.values() for i in join_all(enc, t)]))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(joined, pa.binary())], ["digest", "ids"])

    return run


def encode(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids), a row for each document: its token ids as little-endian unsigned 32-bit integers.

    vocabulary is the path of a byte-level BPE file on every machine. Special tokens in a text become their
    ids; none is added. A null or empty text has no ids. Equal rows stay as many. Other columns are ignored.
    """
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    short = texts.where(F.length("text") < SPREAD).mapInArrow(_encode_whole(vocabulary), f"doc_id {kind}, ids binary")

    long = texts.where(F.length("text") >= SPREAD).withColumn("digest", F.sha2("text", 256))
    rows = written(long.select("doc_id", "digest"))
    parts = long.groupBy("digest").agg(F.first("text").alias("text")).mapInArrow(
        _spread(vocabulary), "digest string, place int, tree int, single boolean, part binary, parts int"
    )
    parts = parts.repartition("digest", "place").mapInArrow(
        _encode_parts(vocabulary), "digest string, place int, tree int, parts int, ids binary"
    )
    whole = parts.groupBy("digest").agg(F.collect_list(F.struct("place", "tree", "ids")).alias("pieces"))
    whole = whole.mapInArrow(_join_parts(vocabulary), "digest string, ids binary")
    return short.unionByName(rows.join(whole, "digest").select("doc_id", "ids"))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded (doc_id, ids, ...) and the text of the ids; bytes that are no UTF-8 become the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in slices(batches, ROWS):
            texts = [
                enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()).decode("utf-8", "replace")
                for x in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{schema}, decoded string")
