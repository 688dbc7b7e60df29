"""Tables on their way: written where the driver and all executors read them, and deleted when they are done with."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, which a cluster names in spark.checkpoint.dir; only in local mode it may be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"


_open: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("scratch", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: a short lineage that lost executors don't touch."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (held := _open.get()) is not None:
        held.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder wherever it is, if it is there."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch() -> Iterator[None]:
    """On leaving, deletes what written() wrote inside, in this thread: for work whose result is stored by then."""
    token = _open.set([])
    try:
        yield
    finally:
        held = _open.get()
        _open.reset(token)
        for spark, path in held:
            delete(spark, path)
