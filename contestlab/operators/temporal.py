"""Joins over time: the last revision at or before each row, and rows in windows, without pairing all with all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, revisions: DataFrame, by: Sequence[str], at: str, values: Sequence[str], before: bool = False) -> DataFrame:
    """rows with the values of the last revision of their key (by) at or before their time (at); with `before`, strictly before. NULL where there is none.

    Rows and revisions are put together and sorted once by key and time, and each row takes up the last revision above it: one
    shuffle, and as many rows as there are of both. Of several revisions of one key and time the greatest values count.
    """
    taken = F.struct(*(F.col(v) for v in values)).alias("_taken")
    one = revisions.groupBy(*by, at).agg(F.max(taken).alias("_taken")).withColumn("_rank", F.lit(2 if before else 0))
    both = rows.select("*", F.lit(None).cast(one.schema["_taken"].dataType).alias("_taken"), F.lit(1).alias("_rank")).unionByName(one, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy(at, "_rank").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_taken", ignorenulls=True).over(order)).filter("_rank = 1")
    return out.select(*rows.columns, *(F.col(f"_last.{v}").alias(v) for v in values))


def in_windows(rows: DataFrame, windows: DataFrame, by: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Each row of rows with each window of its key that it falls into: start < at <= end, all of them dates. Windows may overlap.

    Time is cut into bins as long as windows are on average. A window stands in each bin that it touches and a row in its own, so
    the join meets about as many pairs as there are matches, however many windows a key has.
    """
    days = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    wide = windows.filter(F.col(start) < F.col(end)).agg(F.greatest(F.coalesce(F.avg(F.datediff(end, start)).cast("int"), F.lit(1)), F.lit(1)).alias("_width"))
    # one row
    binned = windows.filter(F.col(start) < F.col(end)).crossJoin(wide)
    first, last = F.floor((days(start) + 1) / F.col("_width")), F.floor(days(end) / F.col("_width"))
    binned = binned.withColumn("_bin", F.explode(F.sequence(first, last))).drop("_width")
    placed = rows.crossJoin(wide).withColumn("_bin", F.floor(days(at) / F.col("_width"))).drop("_width")
    met = placed.join(binned, [*by, "_bin"])
    return met.filter((F.col(start) < F.col(at)) & (F.col(at) <= F.col(end))).drop("_bin")
