"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, which a cluster names in spark.checkpoint.dir.

    Only in local mode, where that may be unset, a folder under the warehouse is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/llm_shared"


_open: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


def materialize(df: DataFrame, name: str, keep: bool = False, records: int = 0) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    keep: also beyond scratch(); records: at most so many in a file, for rows of megabytes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", records).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    if (held := _open.get()) is not None and not keep:
        held.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote for df."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """On leaving, deletes what materialize() wrote inside, in this thread: for work whose result is stored by then."""
    held: list[DataFrame] = []
    token = _open.set(held)
    try:
        yield
    finally:
        _open.reset(token)
        for df in held:
            discard(df)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    while name in df.columns:
        name = "_" + name
    return name


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, octets: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows and, but for a single longer text, about so many bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    a = 0
    while a < batch.num_rows:
        b = min(a + rows, max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + octets, "right"))))
        yield batch.slice(a, b - a)
        a = b


#: DuckDB SQL of a one-row table with the 256 steps of CRC-32 as a list, tab.
CRC_TABLE_SQL = "(SELECT list(list_reduce([i] || range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS tab FROM range(256) r(i))"


def crc32_sql(text: str, tab: str = "tab") -> str:
    """DuckDB SQL of the unsigned CRC-32 of a text's UTF-8 bytes; tab: the column of CRC_TABLE_SQL."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda o: CAST('0x' || o AS BIGINT))"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda c, o: xor({tab}[xor(c, o) % 256 + 1], c // 256)), 4294967295)"
