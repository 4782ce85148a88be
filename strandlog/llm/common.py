"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a session whose tasks all run in the driver's process gets a folder of its own; on a cluster this is an error.
    """
    import tempfile

    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if place is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="strandlog-checkpoints-")
        context.setCheckpointDir(place)
    return place


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of df in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def free_name(taken: list[str], name: str) -> str:
    """A column name like the given one that is not taken; Spark does not tell upper from lower case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def arrow_schema(schema: T.StructType) -> pa.Schema:
    """The Arrow schema of a flat Spark schema."""
    plain = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(f.name, plain[f.dataType.simpleString()]) for f in schema])


@lru_cache(maxsize=1)
def lean_worker() -> None:
    """From now on this Python worker gives the memory of large arrays back when they go; without it a worker that is used again
    keeps what its largest task took. Where the C library knows no such setting, nothing changes."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD: larger blocks are mapped, each on its own
    except (OSError, AttributeError):
        pass


MASK64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix64_int(x: int) -> int:
    return int(mix64(np.array([x & MASK64], dtype=np.uint64))[0])


def byte_table(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte value."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
