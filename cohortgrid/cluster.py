"""Helpers that keep jobs safe at cluster scale: durable tables, checked broadcasts, salted joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 1_000_000
SALTS = 16


def durable(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and continue from there.

    A lost executor then costs a re-read, not a re-run of everything upstream. The folder is the one
    named by spark.checkpoint.dir; only a local session without one gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="cohortgrid-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, for tables that a job writes and reads back."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="cohortgrid-")
    return f"{folder}/{uuid.uuid4().hex}/{name}"


def task_count(spark: SparkSession) -> int:
    """Tasks to spread heavy work over: the cores known now, or the shuffle setting if executors are still
    to come."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fits_broadcast(df: DataFrame, budget: int = BROADCAST_BYTES) -> bool:
    """Measure df (up to one row past the row limit) and tell whether it may be broadcast."""
    size = (
        df.limit(BROADCAST_ROWS + 1)
        .agg(
            F.count("*").alias("rows"),
            F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")), F.lit(0)).alias("bytes"),
        )
        .first()
    )
    return size["rows"] <= BROADCAST_ROWS and size["bytes"] <= budget


def join_side(big: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join big to a table that is usually small: broadcast if it measures small, else salt the keys.

    Salting spreads one key of big over SALTS tasks, so a key that holds a third of the rows does not
    end in one task; side is repeated SALTS times to match. Valid for joins that keep rows of big only
    (inner, left, left_semi, left_anti).
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(side):
        return big.join(F.broadcast(side), keys, how)
    plain = [F.col(f"`{c}`") for c, kind in big.dtypes if not kind.startswith(("array", "map", "struct"))]
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
    salted_side = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted_big.join(salted_side, [*keys, "_salt"], how).drop("_salt")


def require_unique(df: DataFrame, keys: str | list[str]) -> None:
    """Raise if any key occurs twice; counts are combined before the shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    twice = df.groupBy(*keys).count().where("count > 1").select(*keys).take(5)
    if twice:
        raise ValueError(f"duplicate {', '.join(keys)}, e.g. {[tuple(r) for r in twice]}")


def require_aligned(samples: DataFrame, available: DataFrame, key: str) -> None:
    """One job: raise if a sample occurs twice in either table, or has no row in the data."""
    sides = samples.select(F.col(f"`{key}`").alias("id"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        available.select(F.col(f"`{key}`").alias("id"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    counts = sides.groupBy("id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    bad = counts.where("a > 1 OR b > 1 OR (a > 0 AND b = 0)").take(5)
    if bad:
        twice = [r["id"] for r in bad if r["a"] > 1 or r["b"] > 1]
        if twice:
            raise ValueError(f"duplicate {key}, e.g. {twice}")
        raise ValueError(f"samples not in the data, e.g. {[r['id'] for r in bad]}")


def require_present(wanted: DataFrame, available: DataFrame, key: str, what: str) -> None:
    """Raise if a key of wanted has no row in available, naming how many and the first few."""
    missing = wanted.select(key).distinct().join(available.select(key).distinct(), key, "left_anti")
    first = [r[0] for r in missing.orderBy(key).take(5)]
    if first:
        raise ValueError(f"{missing.count()} {what} not in the data, e.g. {first}")
