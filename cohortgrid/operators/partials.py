"""Sums of arrays over all rows, built per task with NumPy and merged by Spark.

Spark bounds the bytes of an Arrow batch (spark.sql.execution.arrow.maxBytesPerBatch), so wide vectors come in
batches of fewer rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame

from cohortgrid.cluster import task_count

SENT_BYTES = 8 << 30
PARTIAL_SCHEMA = "block INT, row INT, v ARRAY<DOUBLE>"


def dense(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """List column -> rows x width; NULL becomes NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    if column.null_count or len(flat) != len(column) * width:
        raise ValueError(f"every vector must have {width} entries")
    return flat.reshape(len(column), width)


def list_column(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def summed(
    df: DataFrame,
    start: Callable[[], dict[int, np.ndarray]],
    add: Callable[[dict[int, np.ndarray], pa.RecordBatch], None],
    finish: Callable[[dict[int, np.ndarray]], None] | None = None,
) -> DataFrame:
    """(block, row, v): the arrays that `add` accumulates per task, summed over all tasks.

    `start` makes zeroed blocks (block id -> 2-d array; a block of negative id is scratch and is not
    sent); `finish` runs once after a task's last batch. A task sends each block row once; Spark adds rows
    of equal key up, each key in one of many tasks. The input keeps its partitions, so that a lost task repeats one
    split; only if their blocks came to more than SENT_BYTES in all are partitions joined, to one per core at least.
    """
    block_bytes = sum(b.nbytes for k, b in start().items() if k >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = start()
        seen = False
        for batch in batches:
            if batch.num_rows:
                seen = True
                add(blocks, batch)
        if seen:
            if finish:
                finish(blocks)
            for block, rows in blocks.items():
                if block < 0:
                    continue
                n = len(rows)
                yield pa.record_batch(
                    [pa.array(np.full(n, block, np.int32)), pa.array(np.arange(n, dtype=np.int32)), list_column(rows)],
                    names=["block", "row", "v"],
                )

    most = max(task_count(df.sparkSession), SENT_BYTES // max(1, block_bytes))
    partials = df.coalesce(most).mapInArrow(run, PARTIAL_SCHEMA)
    return partials.groupBy("block", "row").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))


def collected(sums: DataFrame, shapes: dict[int, tuple[int, int]]) -> dict[int, np.ndarray]:
    """Bring summed blocks to the driver as arrays; the caller bounds their shapes."""
    out = {b: np.zeros(shape) for b, shape in shapes.items()}
    table = sums.toArrow()
    for batch in table.to_batches():
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy(zero_copy_only=False)
        row = batch.column("row").to_numpy(zero_copy_only=False)
        offsets = batch.column("v").offsets.to_numpy()
        values = batch.column("v").values.to_numpy(zero_copy_only=False)
        for i in range(batch.num_rows):
            out[int(block[i])][int(row[i])] = values[offsets[i] : offsets[i + 1]]
    return out
