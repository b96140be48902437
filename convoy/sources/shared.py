"""Storage that the driver and every executor see."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Below which folder of the shared one tables are written now; none: the whole of it.
_scope: ContextVar[str] = ContextVar("convoy_scope", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and every executor see")
        base = "file://" + tempfile.mkdtemp(prefix="convoy-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/convoy/{_scope.get()}{uuid.uuid4().hex}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete what is at path, if anything, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at its end: a job writes its result, or collects it, before that."""
    own = f"{_scope.get()}job-{uuid.uuid4().hex}/"
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        remove(spark, f"{shared_dir(spark)}/convoy/{own}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    This cuts the lineage: an executor lost later costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives, written once; the tables that make wrote on the way go."""
    path = fresh_path(spark, name)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
