"""Tasks that need little memory beside the heap and leave none behind in the Python worker that ran them."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = "1m"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH bytes (or of one longer row), unless the session sets a size of its own.

    A batch lies several times outside an executor's heap, in buffers that double as they
    grow. At Spark's 64 MB each task thread of the executor, and each Python worker, keeps
    what such buffers have held for all later stages of a session.
    """
    if spark.conf.get(KEY, None) is None:
        spark.conf.set(KEY, BATCH)


def _hand_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's, for NumPy's arrays
        trim(0)


def frugal(run: Run) -> Run:
    """A function for mapInArrow that hands free memory back when its task ends.

    Workers serve one task after another, and the allocators keep what a task has freed: tens of
    megabytes a worker after large batches, through all later stages of a session.
    """

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _hand_back()

    return inner
