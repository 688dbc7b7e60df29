import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from contestlab.llm import resample
from tests.llm.cases import HARD, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, buckets, longest=2, share=25, least=20):
    """Rows (doc_id, n_features, weight, score, rank) as the contract has them."""
    home = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(home(f) for x in texts for f in features(x, longest)[1]) for texts in ([d[1] for d in docs], target))
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)}
    rows, fit = [], []
    for d in docs:
        n, found = features(d[1], longest)
        weight = sum(gain[home(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        rows.append([d[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        fit += [rows[-1]] if n >= least else []
    fit.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for i, r in enumerate(fit[: share * len(fit) // 100]):
        r[4] = i + 1
    return Counter(map(tuple, rows))


def corpus():
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("Alpha", "beta", "Øre", "日本", "x1", "The") for b in ("", "s", "2", "ß")]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".\n", "-", "\x00"]) for _ in range(rng.choice([1, 5, 30, 60]))) for _ in range(300)]
    rows = [(i, x, "en", "s") for i, x in enumerate(texts)]
    # a third are copies, of one id or of many, and one word is in most texts
    rows += [(3, texts[3], "en", "s")] * 40 + [(1000 + i, texts[2], "en", "s") for i in range(60)] + [(2000 + i, "the " * 25, "en", "s") for i in range(40)]
    return rows + HARD, rng.sample(texts, 20) + [None, "", "alpha the"]


@pytest.mark.parametrize(("block", "bin_size", "longest", "buckets"), [(1 << 20, 1 << 21, 2, 10_000), (500, 900, 2, 50), (300, 2000, 3, 700)])
def test_ranks_equal_brute_force(spark, monkeypatch, block, bin_size, longest, buckets):
    rows, target = corpus()
    docs, bench = documents(spark, rows), spark.createDataFrame([(x, 1) for x in target], "text string, rank long")
    plain = resample.weights
    monkeypatch.setattr(resample, "weights", lambda *a, **b: plain(*a, **b, block=block, bin_size=bin_size))
    got = resample.resample(docs, bench, longest=longest, buckets=buckets).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, target, buckets, longest)


def test_drawn_lean_to_the_target(spark):
    rng = random.Random(9)
    kinds = {"near": ["stone", "river", "moss"], "far": ["stock", "share", "bond"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(40)), k, "s") for i in range(400) for k in ["near" if i % 2 else "far"]]
    target = spark.createDataFrame([(" ".join(rng.choice(kinds["near"]) for _ in range(40)),) for _ in range(50)], "text string")
    docs = documents(spark, rows)
    drawn = resample.drawn(docs, target).collect()
    assert len(drawn) == 100 and sorted(r.rank for r in drawn) == list(range(1, 101)) and drawn[0].asDict().keys() == {*docs.columns, "rank"}
    assert sum(r.lang == "near" for r in drawn) > 85


def test_empty_tables_and_texts(spark):
    docs, target = documents(spark, HARD), spark.createDataFrame([], "text string")
    assert resample.resample(docs.limit(0), target).count() == 0
    assert Counter(tuple(r) for r in resample.resample(docs, target).collect()) == brute(HARD, [], 10_000)
    blank = [(1, None, "en", "s"), (2, " .", "en", "s")]
    assert all(r.weight == 0 and r["rank"] is None for r in resample.resample(documents(spark, blank), target).collect())


def test_numbers_come_back_as_packed():
    for a in ([], [0], [1, 255, 256, 1 << 31, (1 << 32) - 1] * 9):
        assert resample.unpacked(resample.packed(np.array(a, np.uint32))).tolist() == a


def test_a_name_is_sent_once_a_block():
    text = np.array([0, 1, 0, 1, 2, 0, 1], np.uint32)
    block = resample.Features(resample.zstandard.compress(b"a\nb\nc"), resample.packed(np.array([5, 2], np.uint32)), resample.packed(text), 2, 3)
    found, times = [], defaultdict(int)
    for b, names, counts in block.sent():
        for name, n in zip(resample._names(names).to_pylist(), resample.unpacked(counts).tolist(), strict=True):
            found.append((b, name))
            times[name.strip()] += n
    assert len(set(found)) == len(found) == 6
    assert times == {b"a": 3, b"b": 3, b"c": 1, b"a b": 3, b"b a": 1, b"b c": 1}
