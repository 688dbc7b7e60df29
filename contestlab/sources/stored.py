"""Keyed tables that are kept as files and merged into, a few buckets at a time.

A table is a folder of Parquet files, a subfolder for each bucket of its key's hash. A merge reads and writes only the buckets that its
changes have keys of; files of all others stay as they are. The new buckets are written aside first; then a note of
what is to be swapped is left, and each bucket is swapped by renaming. A run that fails before the note leaves the old rows; what fails
after it is carried on when the table is opened next. One writer at a time; a reader sees each bucket as it was or as it is. A null in a key
equals no other key, as in SQL: such rows come in and are never replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .tables import replace_keys, upsert

BUCKETS = 64
BUCKET, ABOUT, NOTE = "_bucket", "_table.json", "_swap.json"


class _Files:
    """Small files and folders wherever the table is, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.at(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """All of it or nothing: written aside and renamed."""
        aside = f"_{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(aside))
        stream.writeBytes(json.dumps(value))
        stream.close()
        self.move(aside, name)

    def move(self, name: str, to: str) -> None:
        self.fs.mkdirs(self.at(to).getParent())
        if not self.fs.rename(self.at(name), self.at(to)):
            raise OSError(f"can't rename {name} to {to} under {self.root}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class StoredTable:
    """A keyed table under a path. Opening it finishes a swap that was cut short."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, _Files(spark, path)
        about = self.files.read(ABOUT)
        self.keys, self.buckets, self.schema = about["keys"], about["buckets"], StructType.fromJson(about["schema"])
        self._finish()

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> StoredTable:
        """A new table of df's rows; keys need not be unique, but upsert() takes them to be."""
        if BUCKET in df.columns or not set(keys) <= set(df.columns) or not keys:
            raise ValueError(f"keys are columns of the table, and none is named {BUCKET}")
        files = _Files(df.sparkSession, path)
        if files.exists(ABOUT):
            raise FileExistsError(path)
        nullable = StructType.fromJson(json.loads(df.schema.json()))
        for field in nullable:
            field.nullable = True
        files.write(ABOUT, {"keys": list(keys), "buckets": buckets, "schema": nullable.jsonValue()})
        table = cls(df.sparkSession, path)
        table._replace(table._marked(df), None)
        return table

    def read(self) -> DataFrame:
        return self._rows().drop(BUCKET)

    def upsert(self, changes: DataFrame, guard: Column | None = None) -> list[int]:
        """Merge changes by key: new rows come in, known ones are replaced where guard, a test of the stored row, holds. Returns the buckets that were written."""
        return self._merge(changes, lambda own, new: upsert(own, new, self.keys, guard))

    def replace(self, changes: DataFrame) -> list[int]:
        """All rows of the keys that changes have go, and all of changes come in."""
        return self._merge(changes, lambda own, new: replace_keys(own, new, self.keys))

    def delete(self, gone: DataFrame) -> list[int]:
        """All rows of the keys that gone has go."""
        return self._merge(gone.select(*self.keys), lambda own, new: own.join(new.distinct(), self.keys, "left_anti").select(*own.columns))

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add(BUCKET, IntegerType())).parquet(self.path)

    def _marked(self, df: DataFrame) -> DataFrame:
        """df in the table's types, with the bucket of each row."""
        typed = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema if f.name in df.columns))
        return typed.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _merge(self, changes: DataFrame, merged) -> list[int]:
        new = self._marked(changes)
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # no more than there are buckets
        if touched:
            own = self._rows().filter(F.col(BUCKET).isin(touched))  # prunes folders
            self._replace(self._marked(merged(own.drop(BUCKET), new.drop(BUCKET))), touched)
        return touched

    def _replace(self, rows: DataFrame, touched: list[int] | None) -> None:
        """Write rows aside and put them in place of the touched buckets."""
        aside = f"_staged-{uuid.uuid4().hex}"
        try:
            # dealt by bucket; very large buckets are split and small ones put together as they turn out
            rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{aside}")
            staged = [b for b in (touched if touched is not None else range(self.buckets)) if self.files.exists(f"{aside}/{BUCKET}={b}")]
            self.files.write(NOTE, {"aside": aside, "touched": staged if touched is None else touched, "staged": staged})
        except BaseException:
            self.files.delete(aside)
            raise
        self._finish()

    def _finish(self) -> None:
        """Carry out what the note says, from wherever it was left."""
        if not self.files.exists(NOTE):
            return
        note = self.files.read(NOTE)
        aside, old = note["aside"], f"_old-{note['aside']}"
        for b in note["touched"]:
            name = f"{BUCKET}={b}"
            waiting = self.files.exists(f"{aside}/{name}")
            if (waiting or b not in note["staged"]) and self.files.exists(name) and not self.files.exists(f"{old}/{name}"):
                self.files.move(name, f"{old}/{name}")
            if waiting:
                self.files.move(f"{aside}/{name}", name)
        self.files.delete(NOTE)
        self.files.delete(aside)
        self.files.delete(old)
