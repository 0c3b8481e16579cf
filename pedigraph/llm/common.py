"""Small helpers shared by the operators: reading, picking columns, tables written between steps."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from pedigraph.session import checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def at(df: DataFrame, name: str) -> int:
    """Position of a column: the exact name first, then the name in any case."""
    names = df.columns
    if name in names:
        return names.index(name)
    for i, other in enumerate(names):
        if other.lower() == name.lower():
            return i
    raise ValueError(f"no column {name} in {names}")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by position: extra columns never clash with them."""
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_{at(df, n)}").alias(n) for n in names])


BATCH_ROWS = "1000"  # texts an Arrow batch holds while a step is written
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows as Parquet to the shared folder of spark.checkpoint.dir and read them again.

    Cuts the lineage at files that outlive any executor, computes the step once, and
    gives the next plan true sizes.  The write uses smaller Arrow batches than the session.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_ROWS_KEY)
    spark.conf.set(_ROWS_KEY, BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ROWS_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(texts: pa.Array, size: int = 1 << 20) -> Iterator[list[str | None]]:
    """The texts of an Arrow column as lists of about ``size`` bytes, so a batch never stands as Python strings at once."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lengths) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if len(texts) else []
    for lo, hi in zip(edges, edges[1:]):
        yield texts.slice(lo, hi - lo).to_pylist()


_stores: list[Callable[[], None]] = []
_user: list[str] = []


def stored(forget: Callable[[], None]) -> None:
    """Register what a Python worker keeps between tasks, so that another operator can have it dropped."""
    _stores.append(forget)


def trimmed() -> None:
    """Give memory that is free inside this process back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def enter(user: str) -> None:
    """Called by an operator's code on a worker: what other operators keep there is dropped.

    Workers are used again from stage to stage; without this each holds the models and stores of
    all operators that ever ran on it.
    """
    if _user != [user]:
        for forget in _stores:
            forget()
        trimmed()
        _user[:] = [user]
