"""Shuffled shards by a two-pass external shuffle.

Pass one scatters the records over buckets by a seeded hash; there are as many buckets as keep one within a task's
memory. Pass two puts each bucket into a fixed order, shuffles it by Fisher and Yates with a generator seeded
by the bucket, and writes it. Buckets stand one after the other; the row numbers of that order are cut into shards whose
counts differ by one at most. A task that runs again writes the same rows in the same places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import MapType, VariantType

from cohortgrid.llm.common import BROADCAST_ROWS, mix, written

BUCKET_BYTES = 64 << 20  # of text, about
ROW_BYTES = 64  # that a record has besides its text, about
OUT_ROWS = 4096  # records handed on at once
TAGS = ("_bucket", "_tag")


def _scatter(buckets: int, seed: int):
    """Adds the bucket and a tag to records that carry their own hash in _tag.

    Equal records are told apart by how often a task has met them, which does not depend on the order of its rows; so
    copies of one record spread over all buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        for batch in batches:
            own = batch.column("_tag").to_numpy()
            copy = np.empty(len(own), np.uint64)
            for i, key in enumerate(own.tolist()):
                copy[i] = met[key] = met.get(key, -1) + 1
            task = batch.column("_task").to_numpy().astype(np.uint64)
            with np.errstate(over="ignore"):
                tag = mix(own.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
                tag = mix(tag + mix(copy * np.uint64(0xD1342543DE82EF95) + task * np.uint64(2)))
            kept = [c for c in batch.schema.names if c not in ("_tag", "_task")]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array((tag % np.uint64(buckets)).astype(np.int32)), pa.array(tag.view(np.int64))],
                [*kept, *TAGS],
            )

    return run


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """The numbers 0 to n - 1 in an order that is uniform over all."""
    order = np.arange(n)
    draws = np.random.default_rng(seed).integers(0, np.arange(n, 0, -1)) if n else []  # from i on: i + draw
    for i, draw in enumerate(draws):
        order[i], order[i + draw] = order[i + draw], order[i]
    return order


def _shuffle(seed: int):
    """A bucket's records in shuffled order with their place in it; a task holds the records of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        bucket, tag = (table.column(c).to_numpy() for c in TAGS)
        for number in np.unique(bucket).tolist():
            rows = np.flatnonzero(bucket == number)
            rows = rows[np.argsort(tag[rows], kind="stable")]  # equal tags: equal records
            rows = rows[fisher_yates(len(rows), (seed, number))]
            for at in range(0, len(rows), OUT_ROWS):
                part = table.take(pa.array(rows[at : at + OUT_ROWS])).drop_columns(["_tag"])
                places = pa.array(np.arange(at, at + part.num_rows, dtype=np.int64))
                yield from part.append_column("_place", places).combine_chunks().to_batches()

    return run


def shuffled_shards(documents: DataFrame, shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The records of documents in random order, with shard (int, from 0) and slot (long, gapless from 0 in each shard).

    Shards differ by one record at most; the first ones hold the extra records. All columns stay; shard and slot
    replace columns of these names. Null ids and texts are records like others, equal records stay as many. An empty
    table has no rows. The same seed, session and files give the same shards.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    documents = documents.drop("shard", "slot")
    told = [f.name for f in documents.schema if not isinstance(f.dataType, (MapType, VariantType))]
    load = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    buckets = max(shards, -(-(documents.agg(F.sum(load)).first()[0] or 0) // bucket_bytes))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    own = F.xxhash64(*[F.col(f"`{c}`") for c in told]) if told else F.lit(0).cast("long")
    tagged = documents.withColumns({"_tag": own, "_task": F.spark_partition_id()})
    scattered = tagged.mapInArrow(_scatter(buckets, seed), f"{schema}, _bucket int, _tag long")
    dealt = scattered.repartitionById(buckets, F.col("_bucket"))
    placed = written(dealt.mapInArrow(_shuffle(seed), f"{schema}, _bucket int, _place long"))

    sizes = placed.groupBy("_bucket").count().toArrow().sort_by("_bucket")  # two numbers a bucket
    counts = sizes.column("count").to_numpy()
    total = int(counts.sum())
    starts = pa.table({"_bucket": sizes.column("_bucket"), "_start": pa.array(np.cumsum(counts) - counts, pa.int64())})
    offsets = documents.sparkSession.createDataFrame(starts)
    if starts.num_rows <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    least, extra = divmod(total, shards)
    number = F.col("_start") + F.col("_place")
    longer = extra * (least + 1)  # records of the shards that hold one more
    late = number - longer
    shard = F.when(number < longer, F.floor(number / (least + 1))).otherwise(extra + F.floor(late / max(1, least)))
    slot = F.when(number < longer, number % (least + 1)).otherwise(late % max(1, least))
    named = placed.join(offsets, "_bucket").withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")})
    return named.select(*[f"`{c}`" for c in documents.columns], "shard", "slot")


def write_shards(documents: DataFrame, path: str, shards: int, seed: int = 0) -> DataFrame:
    """Write shuffled shards as Parquet, a folder shard=<n> each with rows by slot within a file; returns the table."""
    shuffled_shards(documents, shards, seed).write.partitionBy("shard").parquet(path)
    return documents.sparkSession.read.parquet(path)
