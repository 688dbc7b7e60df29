"""What one task holds of a unit table doesn't grow with the table."""

import re

from pyspark.sql import functions as F

from contestlab.model import TASK_LINES, dealt_by_unit, from_star
from contestlab.plans.views import Views


def test_many_lines_are_dealt_to_as_many_tasks(spark):
    lines = spark.range(1000).select((F.col("id") % 50).alias("unit_id"), (F.col("id") % 3).alias("year"))
    assert dealt_by_unit(lines, 1_000_000) is lines
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for n in (9_000_000, 400 * TASK_LINES, 400 * TASK_LINES + 1):
        dealt = dealt_by_unit(lines, n)
        assert dealt.rdd.getNumPartitions() == max(least, -(-n // TASK_LINES))
        cells = dealt.groupBy("unit_id", "year").count()
        assert cells._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1  # no other shuffle for steps by unit
        assert cells.agg(F.sum("count")).first()[0] == 1000


def test_units_are_not_dealt_by_contest(spark):
    views = Views(from_star(spark, "/root/testdata/sf0.001"))
    for name in ("swing", "swing_vanished", "wide"):
        plan = views[name]._jdf.queryExecution().executedPlan().toString()
        by_contest = [line for line in plan.splitlines() if re.search(r"Join \[(prev_)?contest_id#\d+L?\]", line)]
        assert by_contest and all("BroadcastHashJoin" in line for line in by_contest)
