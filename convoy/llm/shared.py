"""Tables in the folder that the driver and every executor see."""

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import SparkSession

from convoy.sources.shared import fresh_path, materialize, remove, scratch, settled, shared_dir

__all__ = ["fresh_path", "give_back", "lean", "materialize", "remove", "scratch", "settled", "shared_dir", "shuffles_dropped"]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark drops the shuffle files of what is written in here once it is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Memory that is free, but that Arrow's and C's allocators hold, goes back to the system. Does nothing where C's has no such call."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: run, after which the worker gives back what it doesn't use. Workers outlive their tasks and stages, and an executor's memory counts all of them."""

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return then
