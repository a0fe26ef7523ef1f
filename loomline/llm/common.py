"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size, in bytes, of a table that an operator broadcasts.
BROADCAST_LIMIT = 64 * 1024 * 1024

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; a private one is made only
    where that is unset (local runs and tests).
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if path is None:
        path = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="loomline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame, few: bool = False) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    With ``few``, for what is small against the corpus, it gets one file for eight
    shuffle partitions (their number follows the corpus), or two for each core.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if few:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    return df.checkpoint(eager=True)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row.

    A computed column used inside a lambda would be evaluated again for every
    element; a one-element array binds it to a lambda variable instead.
    """
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def small_enough(rows: int, bytes_per_row: int, limit: int = BROADCAST_LIMIT) -> bool:
    """Whether a table of so many rows may be broadcast."""
    return rows * bytes_per_row <= limit


def broadcast_if(df: DataFrame, rows: int, bytes_per_row: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` with a broadcast hint if its counted size is within the limit, else unchanged (a shuffled join)."""
    return F.broadcast(df) if small_enough(rows, bytes_per_row, limit) else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a Python function on the executors holds at once.
ROWS_AT_ONCE = 256


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow with small batches; freed memory goes back to the system at the end of a task.

    Python workers live on after a task; without this each would keep the most that
    any of its tasks had.
    """

    @functools.wraps(run)
    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE))
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # another C library

    return small
