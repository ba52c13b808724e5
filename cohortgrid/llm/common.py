"""Shared helpers: tables in the cluster's folder, checked broadcasts, words and hashes as arrays."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 2_000_000
MEMO_WORDS = 200_000
_LOCAL: list[str] = []
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="corpus-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def written(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many (narrow) rows."""
    return df.limit(rows + 1).count() <= rows


def keep_ids(big: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """big's rows whose id is (left_anti: isn't) in ids; broadcasts ids only if they are counted as few."""
    return big.join(F.broadcast(ids) if small(ids) else ids, on, how)


def text_key(text: Column) -> dict[str, Column]:
    """d1 and d2, 128 bits that stand for a text. Each hashes the text from a seed of its own; with the salt behind
    the text, d2 would follow from d1."""
    return {"d1": F.xxhash64(text), "d2": F.xxhash64(F.lit(1), text)}


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(column, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher(dict):
    """Word to 64-bit hash; keeps a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as UTF-8; null as empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows at most. A worker lives on from stage to stage, so at the end it gives back
    the memory that it has freed."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    if TRIM is not None:
        TRIM(0)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def list_column(arrays: list[np.ndarray]) -> pa.Array:
    """list<int64> from 64-bit arrays."""
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    values = signed(np.concatenate(arrays)) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches whose equal keys stand together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
