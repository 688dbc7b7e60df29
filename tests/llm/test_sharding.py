import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from contestlab.llm import sharding
from contestlab.llm.numbering import numbered
from tests.llm.cases import HARD, documents


def brute_shard(key, weights):
    bids = []
    for i, w in enumerate(weights):
        draw = int(hashlib.md5(f"{key}|{i // 4}".encode()).hexdigest()[i % 4 * 8 :][:8], 16)
        bids.append((-w / math.log((draw + 0.5) / 2**32) if w else -1.0, -i))
    return -max(bids)[1]


@pytest.mark.parametrize("weights", [[1.0] * 24, [1.0], [0.0, 3.0, 1.0, 0.5, 0.0, 2.0]])
def test_shards_equal_brute_force_and_shares(spark, weights):
    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.shard for r in sharding.assign(docs, weights).collect()}
    assert all(got[i] == brute_shard(i, weights) for i in range(0, 4000, 7))
    n = Counter(got.values())
    for i, w in enumerate(weights):
        p = w / sum(weights)
        assert abs(n[i] / 4000 - p) <= 5 * math.sqrt(p * (1 - p) / 4000)


def test_moves_go_to_what_grows_only(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    old, new = [1.0] * 9, [1.0] * 9 + [1.0]
    rows = sharding.moves(docs, old, new).collect()
    assert sum(r.rows for r in rows) == 3000 and sum(r.bytes for r in rows) == 3000 * 11
    moved = [r for r in rows if r.old != r.new]
    assert {r.new for r in moved} == {9} and abs(sum(r.rows for r in moved) / 3000 - 0.1) < 0.03
    heavier = [r for r in sharding.moves(docs, old, [2.0] + [1.0] * 8).collect() if r.old != r.new]
    assert {r.new for r in heavier} == {0}


def test_places_of_hard_rows(spark):
    rows = [*HARD, *[(6, "Same text here\nand there\nand more", "x", "y")] * 40]
    docs = documents(spark, rows)
    got = sharding.placed(docs, [1.0] * 5).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "key" and r.shard == brute_shard("" if r.doc_id is None else r.doc_id, [1.0] * 5)
        assert r.grown_shard in (r.shard, 5) and r.grown_shard == brute_shard("" if r.doc_id is None else r.doc_id, [1.0] * 6)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.placed(docs.limit(0), [1.0]).count() == 0


def test_numbers_are_in_order_across_ranges_and_copies(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") % 700).alias("v"), F.lit("x").alias("n"))
    rows = rows.unionByName(spark.range(900).select(F.lit(1).cast("long").alias("g"), F.lit(None).cast("long").alias("v"), F.lit("x").alias("n")))
    got = defaultdict(list)
    for r in numbered(rows, ["g"], [F.desc_nulls_first("v")], "at", step=100).collect():
        got[r.g].append((r["at"], r.v))
    for found in got.values():
        found.sort()
        values = [math.inf if v is None else v for _, v in found]
        assert [a for a, _ in found] == list(range(len(found))) and values == sorted(values, reverse=True)
    assert len(got[1]) == 900 + 1667


def test_files_hold_every_row_once(spark, tmp_path):
    docs = documents(spark, [*HARD, *[(i, f"text {i % 3}", "en", "s") for i in range(100, 160)]])
    report = sharding.write_shards(docs, str(tmp_path / "out"), [1.0, 1.0, 0.0, 2.0], file_bytes=20_000).collect()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.drop("shard").columns) == sorted(docs.columns) and back.count() == docs.count() == sum(r.rows for r in report)
    assert all(r.shard == brute_shard("" if r.doc_id is None else r.doc_id, [1.0, 1.0, 0.0, 2.0]) for r in back.select("doc_id", "shard").collect())
    assert {r.files for r in report} != {1}  # the long text asks for several files
    assert sharding.write_shards(docs.limit(0), str(tmp_path / "none"), [1.0]).count() == 0


def test_weights_are_checked():
    for weights in ([], [0.0], [-1.0, 1.0], [float("nan")]):
        with pytest.raises(ValueError):
            sharding.shard_of(F.lit("x"), weights)
