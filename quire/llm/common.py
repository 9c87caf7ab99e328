"""What the training-data operators share: table access, staged tables, checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.staging import Staging, partitions

__all__ = ["BROADCAST_ROWS", "Staging", "checked_broadcast", "partitions", "released", "table", "text_or_empty"]

#: A side of a join is broadcast only when it was counted and has at most this many narrow rows (ids, not texts).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked_broadcast(ids: DataFrame) -> DataFrame:
    """``ids`` (a staged, narrow table), marked for broadcast when its counted rows allow it; else left to a shuffle join."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over a task's batches, that gives freed memory back when the task ends.

    Python workers outlive their tasks, and neither Arrow's pool nor the C library returns what was freed by itself.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
