"""Memory of Python workers, which Spark keeps from task to task."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch that goes to Python; a longer row is a batch of its own.
BATCH_BYTES = 6 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts differ in length by orders of magnitude: bound batches by bytes, for the session, where its limit is wider."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Hand freed memory back to the machine at the end of a task that held much."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it keeps what it has
        pass
