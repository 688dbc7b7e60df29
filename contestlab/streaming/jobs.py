"""Structured Streaming forms: deduplicated feeds, calendar windows, running budgets, roll windows, late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contestlab.functions import text as T

FEED = "url string, title string, summary string, published timestamp"


def read_feed(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Feed items as JSON lines, as files arrive."""
    rows = spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_at_once).json(path)
    return rows.filter("url is not null").withColumn("url_hash", T.url_hash(F.col("url")))


def once_each(items: DataFrame, key: str = "url_hash", time: str = "published", memory: str = "30 days") -> DataFrame:
    """The first item of each key; what is older than the memory is forgotten by the watermark."""
    return items.withWatermark(time, memory).dropDuplicatesWithinWatermark([key])


def counts_by_day(rows: DataFrame, time: str, *keys: str, late: str = "1 day") -> DataFrame:
    w = F.window(time, "1 day")
    return rows.withWatermark(time, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("date").alias("day"), *keys, "n")


def counts_by_week(rows: DataFrame, time: str, *keys: str, late: str = "1 day") -> DataFrame:
    """Weeks begin on Mondays; the epoch was a Thursday."""
    w = F.window(time, "7 days", "7 days", "4 days")
    return rows.withWatermark(time, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("date").alias("week"), *keys, "n")


def with_snapshot(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Roll changes (unit_id, day, additions, ...) as they arrive with the last roll at or before their day."""
    s = snapshots.select(F.col("unit_id").alias("s_unit"), F.struct(F.col("day").alias("roll_day"), "electors").alias("roll"))
    rolls = s.groupBy("s_unit").agg(F.sort_array(F.collect_list("roll"), asc=False).alias("rolls"))  # the rolls of one unit
    rows = changes.join(rolls, F.col("unit_id") == F.col("s_unit"), "left").drop("s_unit")
    last = F.try_element_at(F.filter("rolls", lambda r: r["roll_day"] <= F.col("day")), F.lit(1))
    return rows.withColumn("electors", last["electors"]).drop("rolls")


def running_budget(calls: DataFrame, budget: int, degrade: float = 0.8, late: str = "1 day") -> DataFrame:
    """calls (user_id, ts, tokens) as user_id, day, used, state; in update mode, each total that a micro-batch has changed."""
    used = calls.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.sum("tokens").alias("used"))
    state = F.when(F.col("used") >= budget, "blocked").when(F.col("used") >= degrade * budget, "degraded").otherwise("fine")
    return used.select("user_id", F.col("window.start").cast("date").alias("day"), "used", state.alias("state"))


def merge_into(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append each micro-batch as a version of its own; latest() gives the newest row of each key. Safe to run again: a batch overwrites itself."""

    def one(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return df.writeStream.foreachBatch(one).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key; rows are written once for each epoch, so of equal order the later epoch counts."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in keys and c != "epoch"]
    best = F.max(F.struct(F.col(order).alias("o"), "epoch", *rest)).alias("r")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def retained(rows: DataFrame, time: str, days: int, now: str) -> DataFrame:
    """Rows that are no older than so many days."""
    return rows.filter(F.col(time) >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def late_rows(rows: DataFrame, time: str, arrived: str, allowed: str) -> DataFrame:
    """By day: rows that came later than allowed, which a watermark would drop."""
    late = F.col(arrived) > F.col(time) + F.expr(f"INTERVAL {allowed}")
    return rows.groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.sum(late.cast("long")).alias("late"))


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Take in all that is there, then stop: a scheduled job's run. The query's name is its table in memory."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
