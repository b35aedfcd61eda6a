"""What the operators share: the cluster's shared folder, size-checked broadcasts, Arrow helpers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and runs on one machine, as in tests.
OWN_FOLDER = "file:///tmp/checkpoints"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share (spark.checkpoint.dir, or setCheckpointDir)."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        base = OWN_FOLDER
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return f"{_scratch[-1] if _scratch else base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder inside is removed at the end, so results must be written before it, to a path made outside."""
    path = shared_path(spark, "scratch")
    _scratch.append(path)
    try:
        yield
    finally:
        _scratch.remove(path)
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """A folder of the shared one, by the file system that Spark knows for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows (counted), else df itself for a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, upper and lower case alike."""
    known = {c.lower() for c in df.columns}
    while name in known:
        name = f"_{name}"
    return name


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def bigints(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark's signed longs."""
    return pa.array(np.ascontiguousarray(values).view(np.int64), pa.int64())


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that low bits depend on all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
