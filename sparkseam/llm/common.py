"""Helpers that the corpus operators share: shared-folder tables, size-checked broadcast, packing by bytes."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows up to which a table that has been written and counted may be broadcast.
BROADCAST_ROWS = 200_000
#: Spark's setting that a query's shuffle files go when it ends: what written() has written doesn't need them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the rows that go to Python at once, and how many of them if they are texts.
BATCH, TEXTS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one if that is unset and Spark runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept) if kept is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def texts_at_once(spark: SparkSession, rows: int = TEXTS_AT_ONCE) -> None:
    """From now on Python gets rows of texts in batches of at most so many; a lower setting of the session stays.

    Executors hold a batch twice while it grows, outside the heap, and their processes don't return all of it.
    """
    if not 0 < int(spark.conf.get(BATCH)) <= rows:
        spark.conf.set(BATCH, str(rows))


def maybe_broadcast(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a table made by written(), if its counted rows are within the bound; else Spark shuffles."""
    return F.broadcast(df) if df.count() <= most_rows else df


def ascii_lower(col):
    """Lower case for A-Z only; other letters stay."""
    return F.translate(col, UPPER, UPPER.lower())


def n_parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: glibc's numbers of the sizes from which it maps an array apart and gives the heap's end back, and what it comes to by itself.
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3
_USUAL = {_MMAP_THRESHOLD: 32 << 20, _TRIM_THRESHOLD: 64 << 20}


@functools.cache
def _libc():
    return ctypes.CDLL(None) if sys.platform == "linux" else None


def hold_memory() -> None:
    """Freed arrays stay with this worker until give_back(): else the system clears their pages anew for every array."""
    if hasattr(_libc(), "mallopt"):
        for what in _USUAL:
            _libc().mallopt(what, 1 << 30)


#: What a Python worker keeps from task to task.
_KEPT: list = []


def worker_kept(make):
    """A cached function whose results stay with the Python worker until another operator's task calls give_back()."""
    _KEPT.append(functools.cache(make))
    return _KEPT[-1]


def give_back(*used) -> None:
    """Returns freed memory to the system: Spark keeps a task's Python worker for later tasks, beside the executor's heap.

    What worker_kept() functions but those `used` hold is freed before: it is from an earlier stage.
    """
    if left := [f for f in _KEPT if f not in used and f.cache_info().currsize]:
        for f in left:
            f.cache_clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        for what, size in _USUAL.items():
            _libc().mallopt(what, size)
        _libc().malloc_trim(0)


def giving_back(batches: Iterable[pa.RecordBatch], *used) -> Iterator[pa.RecordBatch]:
    """The batches that a task makes; give_back() after each, and once more when the maker holds none any more."""
    for b in batches:
        yield b
        del b
        give_back(*used)
    give_back(*used)
