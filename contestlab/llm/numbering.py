"""Gapless numbers in an order, in groups of any size, without a task that holds a group.

Equal rows are counted first, so that a row that is repeated a billion times is one row until the end. The counted
rows are dealt by ranges of (group, order) and sorted there; sums over ranges, a few numbers for each, say where each
range's numbers begin, and each range numbers its own rows. Equal rows then get their numbers by counting up, the very
many in steps that are dealt out again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize

#: Copies of one row that a task writes out at a time.
STEP = 1 << 18


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, step: int = STEP) -> DataFrame:
    """rows with the column name: 0, 1, 2, ... in the order, anew in each group of by. Rows that the order leaves tied should be equal."""
    n, part, at, start = (free_name(rows, x) for x in ("n", "part", "at", "start"))
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(n))
    dealt = counted.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = materialize(dealt.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "dealt")
    # one row for each range and group that meet: about as many as there are ranges and groups together
    sums = dealt.groupBy(*by, part).agg(F.sum(n).alias(start))
    ranges = Window.partitionBy(*(by or [F.lit(0)])).orderBy(part)
    sums = sums.withColumn(start, F.sum(start).over(ranges) - F.col(start))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (part, *by)]
    inside = F.sum(n).over(Window.partitionBy(part, *by).orderBy(at)) - F.col(n)
    placed = dealt.withColumn(at, inside).alias("a").join(sums.alias("b"), same).select("a.*", (F.col(f"a.{at}") + F.col(f"b.{start}")).alias(start))
    steps = F.explode(F.sequence(F.col(start), F.col(start) + F.col(n) - 1, F.lit(step).cast("long")))
    few = placed.filter(F.col(n) <= step).withColumn(at, F.col(start))
    many = placed.filter(F.col(n) > step).withColumn(at, steps).repartition(at)
    last = F.least(F.col(at) + step, F.col(start) + F.col(n)) - 1
    return few.unionByName(many).select(*rows.columns, F.explode(F.sequence(F.col(at), last)).alias(name))
