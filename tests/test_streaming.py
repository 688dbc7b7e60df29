import datetime
import json

from pyspark.sql import functions as F

from contestlab.streaming import jobs


def rows_of(spark, df, name, tmp_path, mode="append"):
    jobs.run_available(df, name, str(tmp_path / f"c_{name}"), mode).awaitTermination(120)
    return sorted(map(tuple, spark.sql(f"SELECT * FROM {name}").collect()), key=str)


def feed(tmp_path, items):
    (tmp_path / "feed").mkdir(exist_ok=True)
    (tmp_path / "feed" / f"{len(list((tmp_path / 'feed').iterdir()))}.json").write_text("".join(json.dumps(dict(zip(("url", "title", "published"), x, strict=True))) + "\n" for x in items))
    return str(tmp_path / "feed")


def test_feed_once_each_and_weeks(spark, tmp_path):
    path = feed(tmp_path, [("http://A.org/x?utm=1", "one", "2024-01-07T23:00:00Z"), ("http://a.org/x/#top", "two", "2024-01-08T01:00:00Z"), ("http://a.org/y", "three", "2024-01-08T02:00:00Z"), (None, "none", "2024-01-08T02:00:00Z")])
    items = jobs.read_feed(spark, path)
    assert len(rows_of(spark, jobs.once_each(items).select("url_hash"), "once", tmp_path)) == 2
    weeks = jobs.counts_by_week(jobs.read_feed(spark, path), "published")
    assert rows_of(spark, weeks, "weeks", tmp_path, "complete") == [(datetime.date(2024, 1, 1), 1), (datetime.date(2024, 1, 8), 2)]
    days = jobs.counts_by_day(jobs.read_feed(spark, path), "published")
    assert rows_of(spark, days, "days", tmp_path, "complete") == [(datetime.date(2024, 1, 7), 1), (datetime.date(2024, 1, 8), 2)]


def test_budget_runs_over_batches(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    stream = spark.readStream.schema("user_id long, ts timestamp, tokens long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "calls"))
    for k, n in enumerate((50, 35, 20)):
        (tmp_path / "calls" / f"{k}.json").write_text(json.dumps({"user_id": 1, "ts": "2024-01-01T10:00:00Z", "tokens": n}) + "\n")
        q = jobs.running_budget(stream, 100).writeStream.foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(str(tmp_path / f"out/epoch={e}"))).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("used", "state").collect()
    assert sorted(map(tuple, got)) == [(50, "fine"), (85, "degraded"), (105, "blocked")]


def test_snapshots_retention_late_and_merge(spark, tmp_path):
    d = "2024-01-0"
    rolls = spark.createDataFrame([(1, d + "1", 10), (1, d + "5", 20)], "unit_id int, day string, electors int")
    (tmp_path / "changes").mkdir()
    (tmp_path / "changes" / "a.json").write_text("\n".join(json.dumps({"unit_id": u, "day": d + x, "additions": 1}) for u, x in ((1, "4"), (1, "5"), (2, "5"))))
    changes = spark.readStream.schema("unit_id int, day string, additions int").json(str(tmp_path / "changes"))
    assert rows_of(spark, jobs.with_snapshot(changes, rolls), "snap", tmp_path) == [(1, d + "4", 1, 10), (1, d + "5", 1, 20), (2, d + "5", 1, None)]
    t = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-03 00:00:00"), ("2024-01-09 00:00:00", "2024-01-09 00:00:01")], "t string, a string").select(*(F.col(c).cast("timestamp").alias(c) for c in "ta"))
    assert jobs.retained(t, "t", 5, "2024-01-10").count() == 1
    assert sorted(tuple(r)[1:] for r in jobs.late_rows(t, "t", "a", "1 day").collect()) == [(1, 0), (1, 1)]
    for _ in range(2):
        jobs.merge_into(changes, str(tmp_path / "m"), str(tmp_path / "mc")).awaitTermination(120)
    assert sorted(map(tuple, jobs.latest(spark, str(tmp_path / "m"), ["unit_id"], "day").collect())) == [(1, d + "5", 1), (2, d + "5", 1)]
