"""Reading typed CSV and writing tables: keyed merges, replacement by key, CSV, GeoJSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV file with a header, by the names in it: blank cells are NULL, blank rows go, numbers and booleans that can't be read are NULL."""
    want = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).csv(path)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))  # a byte order mark is no part of the first name

    def typed(field) -> Column:
        if field.name not in raw.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        x = F.nullif(F.trim(F.col(f"`{field.name}`")), F.lit(""))
        if isinstance(field.dataType, BooleanType):
            x = F.when(F.lower(x).isin("1", "true", "t", "yes", "y"), True).when(x.isNotNull(), False)
        elif not isinstance(field.dataType, StringType):
            x = x.try_cast(field.dataType)
        return x.alias(field.name)

    return raw.dropna("all").select(*(typed(f) for f in want)).dropna("all")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], guard: Column | None = None) -> DataFrame:
    """target with changes merged in by key: new rows come in, and known rows are replaced where guard, a test of
    the stored row, holds (everywhere without one). Of changes with one key the last by all columns counts."""
    order = F.struct(*(F.col(c) for c in target.columns if c not in keys))
    last = changes.groupBy(*keys).agg(F.max(order).alias("_new")).select(*keys, "_new", F.lit(True).alias("_changed"))
    own = target.withColumn("_kept", F.coalesce(~guard, F.lit(True)) if guard is not None else F.lit(False)).withColumn("_stored", F.lit(True))
    rows = own.join(last, keys, "full")
    change = F.col("_changed") & (F.col("_stored").isNull() | ~F.coalesce("_kept", F.lit(False)))
    take = F.coalesce(change, F.lit(False))
    return rows.select(*(c if c in keys else F.when(take, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in target.columns))


def replace_keys(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """target without any row of a key that changes has, and all of changes."""
    return target.join(changes.select(*keys).distinct(), keys, "left_anti").select(*target.columns).unionByName(changes.select(*target.columns))


def store(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a table, or with partition_by only the partitions that df has rows for."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def swap(df: DataFrame, path: str) -> DataFrame:
    """A table computed from itself: written aside as a version of its own, which is returned."""
    version = f"{path}/version-{uuid.uuid4().hex}"
    df.write.parquet(version)
    return df.sparkSession.read.schema(df.schema).parquet(version)


def write_csv(df: DataFrame, path: str) -> None:
    """As many files as df has partitions, each with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def features(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """feature: one GeoJSON feature a row, with null geometry where a coordinate is missing."""
    point = F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(F.col(lon).cast("double"), F.col(lat).cast("double")).alias("coordinates")))
    rest = F.struct(*(F.col(c) for c in df.columns if c not in (lon, lat)))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), rest.alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def write_geojson(df: DataFrame, path: str, lon: str = "lon", lat: str = "lat") -> dict[str, int]:
    """Newline-delimited features, and how many of them have no place."""
    features(df, lon, lat).write.mode("overwrite").text(path)
    n = df.agg(F.count(F.lit(1)).alias("features"), F.coalesce(F.sum((F.col(lon).isNull() | F.col(lat).isNull()).cast("long")), F.lit(0)).alias("without_place")).first()
    return n.asDict()
