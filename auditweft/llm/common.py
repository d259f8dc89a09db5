"""Shared helpers: reading tables, durable intermediate tables, Arrow batch slicing, worker memory."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any, TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession

_OWN: dict[str, str] = {}
_HELD: dict[str, object] = {}
Table = TypeVar("Table")


def held(key: str, make: Callable[[], Table]) -> Table:
    """What ``make`` gives, kept in the worker between tasks of one key; another key's table goes first."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD[key] = make()
    return _HELD[key]  # type: ignore[return-value]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode without a setting."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN[key]


def persisted(df: DataFrame, name: str = "t") -> DataFrame:
    """Write to the shared folder and read back: lineage ends at files that outlive an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **of: Column) -> tuple[DataFrame, dict[str, Any]]:
    """Like ``persisted``, with aggregates of the rows taken while they are written, without a job of their own."""
    seen = Observation()
    out = persisted(df.observe(seen, *(c.alias(n) for n, c in of.items())), name)
    return out, seen.get


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(col: pa.Array, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column whose bytes stay near max_bytes (a longer text stands alone)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > max_bytes:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
