"""Streams that remember: titles that are near to earlier ones, budgets call by call, and counts of what came too late.

The state is Spark's own (RocksDB, checkpointed with the stream), keyed so that a micro-batch touches only what it has rows for. Event-time
timers let go of what is older than the memory, also under keys that never come again.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from contestlab.functions import text as T
from contestlab.operators.dedupe import settle, sorted_join
from contestlab.shared import scratch, written

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which stateful processors need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


#: Pairs that are compared at once, or all together in a key with few titles.
PAIRS = 1 << 18


def quarter_keys(simhash: Column) -> list[Column]:
    """The four keys of a hash, A to D: its quarters from the first. Hashes within 3 bits share one at least."""
    part = lambda n: F.shiftrightunsigned(simhash, 48 - 16 * n).bitwiseAND(F.lit(0xFFFF))
    return [F.concat(F.lit("ABCD"[n]), F.lpad(F.hex(part(n)), 4, "0")) for n in range(4)]


def _to_compare(new: np.ndarray, known: np.ndarray, quarter: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in new and known, hashes of one key, to be compared: all pairs that are within 3 bits are among them.

    All pairs of few; of many, those that agree in one of four parts of the other 48 bits.
    """
    if len(new) * len(known) <= PAIRS:
        yield np.repeat(np.arange(len(new)), len(known)), np.tile(np.arange(len(known)), len(new))
        return
    turned = [h << np.uint64(16 * quarter) | h >> np.uint64(64 - 16 * quarter) if quarter else h for h in (new, known)]  # the key comes first
    for shift in (36, 24, 12, 0):
        own, other = (h >> np.uint64(shift) & np.uint64(0xFFF) for h in turned)
        order = np.argsort(other, kind="stable")
        first, last = (np.searchsorted(other[order], own, side) for side in ("left", "right"))
        ends = np.cumsum(last - first)
        a = 0
        while a < len(new):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            n = (last - first)[a:b]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(np.arange(a, b), n), order[np.repeat(first[a:b], n) + within]
            a = b


class NearTitles(StatefulProcessor):
    """For one quarter of the hashes: the titles of the last `memory` seconds that have it, the first of each hash. Gives links to the earlier ones.

    Rows are (key, id, simhash, at); at: event time in seconds. Each title but copies also comes out by itself, once, under its first key.
    A micro-batch reads the titles of its keys and adds its own; a key has one timer, for the oldest of its titles.
    """

    def __init__(self, memory: int, threshold: int):
        self.memory, self.threshold = memory, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getListState("known", "id long, simhash long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [tuple(x) for x in self.known.get()]
        titles, place, new = list(held), {h: n for n, (_, h, _) in enumerate(held)}, []
        until: dict[int, int] = {}  # the title that a place has given way to
        for r in sorted(rows, key=lambda r: r.id):
            before = place.get(r.simhash)
            if before is not None:
                if titles[before][2] > r.at - self.memory:
                    continue  # a copy goes, whatever became of the first
                until[before] = len(titles)
            place[r.simhash] = len(titles)
            new.append(len(titles))
            titles.append((r.id, r.simhash, r.at))
        if not new:
            return
        if key[0].startswith("A"):
            for n in new:
                yield Row(id=titles[n][0], simhash=titles[n][1], near=None, before=False)
        yield from self._links(titles, len(held), until, "ABCD".index(key[0][0]))
        if any(n < len(held) for n in until):
            self.known.put([x for n, x in enumerate(titles) if n not in until])
        else:
            self.known.appendList([titles[n] for n in new if n not in until])
        if not held:
            self._wake(titles)

    def _links(self, titles: list[tuple[int, int, int]], old: int, until: dict[int, int], quarter: int) -> Iterator[Row]:
        hashes, at = (np.array([x[c] for x in titles], np.int64) for c in (1, 2))
        hashes, end = hashes.view(np.uint64), np.full(len(titles), len(titles))
        for n, by in until.items():
            end[n] = by
        for i, j in _to_compare(hashes[old:], hashes, quarter):
            i = i + old
            near = (j < i) & (i <= end[j])
            i, j = i[near], j[near]
            near = (np.bitwise_count(hashes[i] ^ hashes[j]) <= self.threshold) & (at[j] > at[i] - self.memory)
            for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
                yield Row(id=titles[a][0], simhash=titles[a][1], near=titles[b][0], before=b < old)

    def _wake(self, titles: list[tuple[int, int, int]]) -> None:
        self.handle.registerTimer((min(at for _, _, at in titles) + self.memory) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        left = [x for x in map(tuple, self.known.get()) if (x[2] + self.memory) * 1000 > now]
        if left:
            self.known.put(left)
            self._wake(left)
        else:
            self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def _first_copies(memory: int):
    def run(batches):
        """Copies of a hash that come within the memory of one in the same batch go here: they go anyhow, and a hash that most rows have is no hot key then."""
        for batch in batches:
            i, h, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "simhash", "at"))
            order = np.lexsort((i, h))
            keep, last = [], None
            for n in order.tolist():
                if last is None or h[n] != h[last] or at[n] - memory >= at[last]:
                    keep.append(n)
                    last = n
            yield batch.take(pa.array(sorted(keep), pa.int64()))

    return run


def near_titles(items: DataFrame, memory: timedelta, threshold: int = T.HAMMING, late: str = "1 day") -> DataFrame:
    """items (id, simhash, seen) as a stream: id, simhash, near, before. near: an earlier title within threshold bits, seen within the memory; before: in an earlier micro-batch. A row without near for each title, but for copies of a hash whose first was seen within the memory."""
    seconds = int(memory.total_seconds())
    rows = items.withWatermark("seen", late).select("id", "simhash", "seen", F.unix_seconds("seen").alias("at"))
    rows = rows.mapInArrow(_first_copies(seconds), rows.schema)
    keyed = rows.withColumn("key", F.explode(F.array(*quarter_keys(F.col("simhash")))))
    return keyed.groupBy("key").transformWithState(NearTitles(seconds, threshold), "id long, simhash long, near long, before boolean", "append", "EventTime")


def keep_new_titles(items: DataFrame, path: str, checkpoint: str, memory: timedelta = timedelta(days=30), threshold: int = T.HAMMING, late: str = "1 day") -> StreamingQuery:
    """items (id, simhash, seen; ids grow with time): stores under path those to which no earlier one that it kept, of the last `memory`, is near.

    A copy of a hash whose first came within the memory goes too, whatever became of the first. A title that comes more than `late` behind the newest is dropped. What an earlier micro-batch kept is looked up only for the titles that are linked to, by the range of their ids; nothing that is
    stored is written again. Safe to run again: a micro-batch overwrites itself.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        with scratch():
            found = written(batch, "titles")
            links = found.filter("near is not null").select(F.col("near").alias("u"), F.col("id").alias("v"), "before").distinct()
            old = written(links.filter("before").select("u", "v"), "old")
            first, last = old.agg(F.min("u"), F.max("u")).first()
            gone = old.select(F.col("v").alias("id")).limit(0)
            if first is not None:
                stored = spark.read.schema("id long, simhash long, epoch long").parquet(path).filter(F.col("epoch") < epoch)
                kept = stored.filter(F.col("id").between(first, last)).select(F.col("id").alias("u"))
                gone = sorted_join(old, kept, "u", "left_semi").select(F.col("v").alias("id")).distinct()
            gone = written(gone, "gone")
            new = links.filter(~F.col("before")).select("u", "v")
            for end in "uv":
                new = sorted_join(new, gone.withColumnRenamed("id", end), end, "left_anti").select("u", "v")
            gone = gone.unionByName(settle(written(new, "new")))
            kept = sorted_join(found.filter("near is null").select("id", "simhash"), gone, "id", "left_anti")
            kept.sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    links = near_titles(items, memory, threshold, late)
    with rocks(items.sparkSession):
        return links.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class CallBudget(StatefulProcessor):
    """For one user: what is used of each day. Rows are (user_id, call_id, ts, day, tokens, budget), decided in order of (ts, call_id)."""

    def __init__(self, degrade: float):
        self.degrade = degrade

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day date", "used long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        used: dict[date, int] = {}
        for r in sorted(rows, key=lambda r: (r.ts, r.call_id)):
            if r.day not in used:
                if self.days.containsKey((r.day,)):
                    used[r.day] = self.days.getValue((r.day,))[0]
                else:
                    used[r.day] = 0
                    # the day's end, in the watermark's time
                    self.handle.registerTimer((r.day - date(1970, 1, 1)).days * 86_400_000 + 86_400_000)
            spent = used[r.day]
            state = "blocked" if spent >= r.budget else "degraded" if spent >= self.degrade * r.budget else "fine"
            yield Row(user_id=r.user_id, call_id=r.call_id, day=r.day, used=spent, state=state)
            if state != "blocked":  # a call that is turned away costs nothing
                used[r.day] += r.tokens
        for day, spent in used.items():
            self.days.updateValue((day,), (spent,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        today = timerValues.getCurrentWatermarkInMs() // 86_400_000
        for (day,) in list(self.days.keys()):
            if (day - date(1970, 1, 1)).days < today:
                self.days.removeKey((day,))
        return iter(())

    def close(self) -> None:
        pass


def decided_calls(calls: DataFrame, budget: int, degrade: float = 0.8, late: str = "1 day") -> DataFrame:
    """calls (user_id, call_id, ts, tokens, and perhaps budget, the user's own) as a stream, each with what its user has used of the day before it, and the decision: fine, degraded or blocked.

    Calls are decided as they arrive, within a micro-batch by time; days end by UTC. The state is a number for each user and day that late calls can still belong to.
    """
    own = F.coalesce(F.col("budget").cast("long"), F.lit(budget).cast("long")) if "budget" in calls.columns else F.lit(budget).cast("long")
    day = F.date_from_unix_date(F.floor(F.unix_seconds("ts") / 86_400).cast("int"))
    rows = calls.withWatermark("ts", late).select("user_id", "call_id", "ts", day.alias("day"), F.col("tokens").cast("long").alias("tokens"), own.alias("budget"))
    return rows.groupBy("user_id").transformWithState(CallBudget(degrade), "user_id long, call_id long, day date, used long, state string", "append", "EventTime")


class Progress(StreamingQueryListener):
    """Gathers, for one query and each of its micro-batches, what was observed and what the watermark has dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.batches, self.run_id, self._all, self._ended = spark, {}, None, {}, threading.Event()
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        if p["numInputRows"]:
            dropped = sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])
            self._all.setdefault(p["runId"], {})[p["batchId"]] = {"observed": p.get("observedMetrics", {}), "dropped": dropped, "watermark": p["eventTime"].get("watermark")}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.run_id is None or str(event.runId) == self.run_id:
            self._ended.set()

    def of(self, query: StreamingQuery, seconds: float = 60) -> dict[int, dict]:
        """By batch, once the query has ended and all its events are in."""
        self.run_id = str(query.runId)
        query.awaitTermination()
        self._ended.wait(seconds)
        self.spark.streams.removeListener(self)
        return self._all.get(self.run_id, {})


def once_each_counted(rows: DataFrame, key: str, time: str, late: str, path: str, checkpoint: str) -> DataFrame:
    """Store the first row of each key under path, as they arrive; returns batch, rows, first, last, late: of each micro-batch how many rows came, their times, and how many came too late and were dropped.

    The counts are the stream's own: metrics observed on its rows, and its progress.
    """
    spark = rows.sparkSession
    seen = rows.observe("arrived", F.count(F.lit(1)).alias("rows"), F.min(F.unix_micros(time)).alias("first"), F.max(F.unix_micros(time)).alias("last"))
    once = seen.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    progress = Progress(spark)
    query = once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    found = [(b, m["observed"]["arrived"]["rows"], m["observed"]["arrived"]["first"], m["observed"]["arrived"]["last"], m["dropped"]) for b, m in sorted(progress.of(query).items())]
    # a row for each micro-batch of this run
    table = spark.createDataFrame(found, "batch long, rows long, first long, last long, late long")
    return table.select("batch", "rows", *(F.timestamp_micros(c).alias(c) for c in ("first", "last")), "late")
