"""What the operators of this subpackage share: shared-folder tables, components, column checks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import materialize, new_folder, shared_dir

__all__ = ["all_of", "arrow_rows", "connected_components", "crc_mod", "give_back", "materialize", "need", "new_folder", "shared_dir", "small", "tidy"]


def need(df: DataFrame, *columns: str) -> None:
    """Raise a clear error before any job starts if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


#: A side of a join is broadcast only if it was counted to have at most so many narrow rows (16 bytes each).
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if a count finds at most BROADCAST_ROWS rows; else joins shuffle both sides."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string")) % n


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send at most ``rows`` rows to a worker at once; the caller's setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return freed memory of this process to the system: workers wait for their next task with what they last held, beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and then ``give_back`` once it has ended and dropped what it held."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
