"""What grows with the titles goes through shuffles, and shingles are digested once."""

import hashlib
from collections import Counter
from unittest import mock

from contestlab.functions import text as T
from contestlab.operators import dedupe


def test_titles_are_not_sent_whole_through_the_driver(spark, tmp_path):
    spark.createDataFrame([(i, i * 0x9E3779B97F4A7C15 % (1 << 62)) for i in range(200)], "id long, simhash long").write.parquet(f"{tmp_path}/hashes")
    stored = spark.read.parquet(f"{tmp_path}/hashes")
    for df in (dedupe.links(stored), dedupe.first_seen(stored)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def _plain(folded: str) -> int:
    t = folded.replace(" ", "")
    counts = Counter(t[i : i + 3] for i in range(len(t) - 2)) if len(t) > 3 else Counter([t])
    digests = {s: int.from_bytes(hashlib.md5(s.encode()).digest()[:8], "big") for s in counts}
    bits = sum(1 << b for b in range(64) if 2 * sum(n for s, n in counts.items() if digests[s] >> b & 1) > counts.total())
    return bits - (1 << 64) if bits >> 63 else bits


def test_a_shingle_is_digested_once_for_all_texts():
    texts = ["abc", "abcd", "aaaaaaa", "the quick brown fox", "हिन्दी में लिखा", "😀😀😀😀x", "\U0010ffff\U0010ffffab"]
    assert [T.simhash64(t) for t in texts] == [_plain(t) for t in texts]
    with mock.patch.object(T.hashlib, "md5", wraps=hashlib.md5) as md5:
        assert [T.simhash64(t) for t in texts[1:]] == [_plain(t) for t in texts[1:]]
    assert md5.call_count == sum(len({t.replace(" ", "")[i : i + 3] for i in range(len(t.replace(" ", "")) - 2)}) for t in texts[1:])  # those of _plain alone


def test_shingles_are_forgotten_in_time():
    with mock.patch.object(T, "REMEMBERED", 5):
        texts = ["one two three", "four five six", "seven eight nine"] * 2
        assert [T.simhash64(t) for t in texts] == [_plain(t) for t in texts]
