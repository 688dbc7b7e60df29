"""Streams with state, against the same rule over all rows at once."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from contestlab.operators.dedupe import first_seen
from contestlab.streaming import state

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def titles(rng, n):
    """Hashes in chains: each new one is far from all, a copy, or up to three bits from an earlier one."""
    out = []
    for _ in range(n):
        h = rng.getrandbits(64)
        if out and rng.random() < 0.6:
            h = rng.choice(out[-40:])
            for _ in range(rng.choice([0, 1, 2, 3])):
                h ^= 1 << rng.randrange(64)
        out.append(h)
    return [h - (1 << 64) if h >> 63 else h for h in out]


def drop(path, k, rows):
    path.mkdir(exist_ok=True)
    file = path / f"{k:04}.json"
    file.write_text("".join(json.dumps(r, default=lambda t: t.isoformat()) + "\n" for r in rows))
    os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken by their time


def take_in(spark, path, tmp_path, memory):
    stream = spark.readStream.schema("id long, simhash long, seen timestamp").option("maxFilesPerTrigger", 1).json(str(path))
    q = state.keep_new_titles(stream, str(tmp_path / "kept"), str(tmp_path / "progress"), memory)
    q.awaitTermination(300)
    assert q.exception() is None
    return q


def kept(spark, tmp_path):
    return {r.id for r in spark.read.parquet(str(tmp_path / "kept")).collect()}


def test_near_titles_equal_the_rule_over_all_rows(spark, tmp_path):
    hashes = titles(random.Random(4), 160) + [77] * 60  # one hash that many have
    rows = [{"id": i, "simhash": h, "seen": START + timedelta(minutes=i)} for i, h in enumerate(hashes)]
    for k, (a, b) in enumerate(((0, 50), (50, 51), (51, 140))):
        drop(tmp_path / "in", k, rows[a:b])
    take_in(spark, tmp_path / "in", tmp_path, timedelta(days=30))
    drop(tmp_path / "in", 3, rows[140:])  # in a later run, from the state of the one before
    take_in(spark, tmp_path / "in", tmp_path, timedelta(days=30))
    want = first_seen(spark.createDataFrame(list(enumerate(hashes)), "id long, simhash long"))
    assert kept(spark, tmp_path) == {r.id for r in want.filter("kept").collect()}


def test_memory_lets_go(spark, tmp_path):
    """A copy is new again once the memory of the first is over, and what is forgotten takes no room."""
    rows = [{"id": i, "simhash": [5, 6, 9_000][i % 3] if i % 2 else (i + 1) * 0x9E3779B97F4A7C15 % (1 << 62), "seen": START + timedelta(days=i)} for i in range(48)]
    for k in range(12):
        drop(tmp_path / "in", k, rows[4 * k : 4 * k + 4])
    q = take_in(spark, tmp_path / "in", tmp_path, timedelta(days=8))
    want, memory, firsts = set(), [], {}
    for r in rows:
        live = r["seen"] - timedelta(days=8)
        if r["simhash"] not in firsts or firsts[r["simhash"]] <= live:
            firsts[r["simhash"]] = r["seen"]
            if not any(m["seen"] > live and (m["simhash"] ^ r["simhash"]).bit_count() <= 3 for m in memory):
                want.add(r["id"])
                memory.append(r)
    assert kept(spark, tmp_path) == want
    sizes = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert max(sizes[6:]) <= 1.3 * max(sizes[3:6])


def test_calls_are_decided_in_order(spark, tmp_path):
    rng, rows = random.Random(7), []
    for i in range(300):
        rows.append({"user_id": rng.choice([1, 1, 2, None]), "call_id": i, "ts": START + timedelta(minutes=17 * i), "tokens": rng.randrange(40), "budget": 50 if i % 3 else None})
    for k in range(5):
        drop(tmp_path / "in", k, rng.sample(rows[60 * k : 60 * k + 60], 60))
    stream = spark.readStream.schema("user_id long, call_id long, ts timestamp, tokens long, budget long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    with state.rocks(spark):
        q = state.decided_calls(stream, 100).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    used, want = {}, set()
    for r in rows:
        at, most = (r["user_id"], r["ts"].date()), r["budget"] or 100
        spent = used.get(at, 0)
        verdict = "blocked" if spent >= most else "degraded" if spent >= 0.8 * most else "fine"
        want.add((r["user_id"], r["call_id"], at[1], spent, verdict))
        used[at] = spent + (r["tokens"] if verdict != "blocked" else 0)
    got = spark.read.parquet(str(tmp_path / "out")).select("user_id", "call_id", "day", "used", "state").collect()
    assert {tuple(r) for r in got} == want and len(got) == 300 and {r.state for r in got} == {"fine", "degraded", "blocked"}
    last = json.loads(q.recentProgress[-1].json)["stateOperators"][0]
    assert last["numRowsTotal"] <= 3 * 4 + 20  # days that are over are gone


def test_rocks_restores_the_setting(spark):
    before = spark.conf.get(state.PROVIDER)
    with state.rocks(spark):
        assert spark.conf.get(state.PROVIDER) == state.ROCKS
    assert spark.conf.get(state.PROVIDER) == before


def test_late_rows_are_counted_by_the_stream(spark, tmp_path):
    days = [[0, 1, 2], [3, 4], [5, 0, 1], [6, 2, 2, 7]]
    for k, found in enumerate(days):
        drop(tmp_path / "in", k, [{"i": 10 * k + n, "t": START + timedelta(days=d)} for n, d in enumerate(found)])
    stream = spark.readStream.schema("i long, t timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = state.once_each_counted(stream, "i", "t", "12 hours", str(tmp_path / "out"), str(tmp_path / "p")).orderBy("batch").collect()
    assert [(r.batch, r.rows) for r in got] == [(0, 3), (1, 2), (2, 3), (3, 4)]
    # micro-batch 2 drops by the watermark after 0, day 1.5; micro-batch 3 by that after 1, day 3.5
    assert [r.late for r in got] == [0, 0, 2, 2]
    assert spark.read.parquet(str(tmp_path / "out")).select(F.count("i")).first()[0] == 8
