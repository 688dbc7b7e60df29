"""All pairs of stations over many copies: texts are keyed once, few names don't share one task, and similarity is what the plain rule gives."""

import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from contestlab.functions import text as T
from contestlab.operators import match as X

COPIES = 30


def parts(spark, folder):
    """Three names of one brand, COPIES of each on both sides."""
    rows = [(10 * i + k, f"widget {k // 2}", "Brand#1", "SMALL", 7, 1.0) for i in range(COPIES) for k in range(6)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    return rows


def test_texts_are_keyed_once_for_their_copies(spark, tmp_path, monkeypatch):
    rows, keyed, whole = parts(spark, tmp_path), [], X.keyed

    def counted(stations):
        keyed.append(stations.count())
        return whole(stations)

    monkeypatch.setattr(X, "keyed", counted)
    pairs = entry.queries()["xwalk_score"](spark, str(tmp_path))
    assert keyed == [3, 3]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    scans = re.findall(r"Window \[(?:(?!Window \[).)*?Relation ", plan, re.S)
    assert scans and not any("regexp" in scan for scan in scans)  # nor is a filter on what they are keyed to run on every row
    got = [(r.station, r.anchor) for r in pairs.collect()]
    ids = [r[0] for r in rows]
    assert sorted(got) == sorted((a, b) for a in ids for b in ids if a % 2 and not b % 2)


def test_few_names_with_many_ids_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_IDS", 16)
    monkeypatch.setattr(X, "MEMBERS", 8)
    schema = "group_id int, station long, building string, place string, part int, kind string"
    old = [(1, i, "north school", "town", 1, "SCHOOL") for i in range(100)] + [(2, 500, "hall", None, None, None)]
    anchors = [(1, 1000 + i, "south hall", "town", i % 2, "HALL") for i in range(90)] + [(2, 1500, "hall", None, None, None)]
    pairs = X.score_pairs(spark.createDataFrame(old, schema), spark.createDataFrame(anchors, schema))
    dealt = pairs.withColumn("task", F.spark_partition_id()).filter("group_id = 1").groupBy("task").count().collect()
    assert len(dealt) > 8 and max(r["count"] for r in dealt) < 100 * 90 / 4
    got = sorted((r.group_id, r.station, r.anchor, r.score) for r in pairs.collect())
    assert got == sorted((a[0], a[1], b[1], X._score(a[2:], b[2:])) for a in old for b in anchors if a[0] == b[0])


def test_ids_are_gathered_whole(spark, monkeypatch):
    monkeypatch.setattr(X, "MEMBERS", 4)
    rows = [("a", [i]) for i in range(11)] + [("b", [100, 101, 102]), ("b", [103, 104, 105]), ("b", [106]), (None, [200])]
    got = X._gathered(spark.createDataFrame(rows, "name string, ids array<long>"), ["name"]).collect()
    assert all(len(r.ids) < 2 * 4 for r in got) and sum(r.name == "a" for r in got) == 3
    assert sorted((str(r.name), i) for r in got for i in r.ids) == sorted((str(n), i) for n, ids in rows for i in ids)


def plain_jaro(a, b):
    if a == b:
        return 1.0
    reach, used, pairs = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(i + reach + 1, len(b))) if b[j] == ch and j not in used), None)
        if j is not None:
            used.add(j)
            pairs.append(ch)
    if not pairs:
        return 0.0
    swapped = sum(x != b[j] for x, j in zip(pairs, sorted(used), strict=True)) // 2
    m = len(pairs)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def test_jaro_is_the_plain_rule():
    rng = random.Random(2)
    for letters, most in (("ab", 9), ("abcde é", 14), ("विद्यालय school", 80)):
        for _ in range(3000 if most < 20 else 300):
            a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(2))
            assert T.jaro(a, b) == plain_jaro(a, b)
