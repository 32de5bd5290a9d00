"""Session settings and small helpers that the operators of this subpackage use."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, new_dir, release, ship

__all__ = ["cut", "give_back", "new_dir", "release", "small_batches", "utf8"]


#: Rows of an Arrow batch, low because single texts can be very long. It is one number for all operators, as the setting
#: is read when a plan runs, not when it is made.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Ship the package, and set the rows of an Arrow batch."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later tasks, and a heavy task's would stay large."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
