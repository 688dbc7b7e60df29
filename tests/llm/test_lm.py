import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from contestlab.llm import lm
from tests.llm.cases import HARD, documents


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), b"\n"]


def brute(rows):
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in rows]
    count = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in tokens(t))
    n, v = sum(count.values()), len(count)
    return [(d, h, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t))) for (d, t), h in zip(rows, held, strict=True)]


def check(docs, rows):
    got = sorted((tuple(r) for r in lm.score(docs, *lm.learn(docs)).collect()), key=str)
    want = sorted(brute(rows), key=str)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6) and g[6] <= 0
    return got


@pytest.mark.parametrize("share", [0.0, 0.01])
def test_base_scores_equal_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(lm, "HEAD_SHARE", share)
    monkeypatch.setattr(lm, "CHUNK", 7)
    rng = np.random.default_rng(0)
    words = ["the river Walks", "of río tion", "x" * 20 + " yes", *(f"r{i}" for i in range(200))]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40), p=[0.3, 0.3, 0.3, *[0.1 / 200] * 200]))) for i in range(150)]
    got = check(documents(spark, [(*r, "en", "s") for r in rows]), rows)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_states_are_distributions_of_the_longest_suffix(spark):
    docs = documents(spark, [(i, "abra cadabra alakazam " * 30, "en", "s") for i in range(30)])
    tree = lm.learn(docs)[2]
    for context in (b"\n" * 6, b"abra c", b"zzzzzz", b" alaka"):
        code = np.array([int.from_bytes(context[-lm.ORDER :], "big") << 8 | s for s in range(256)], np.uint64)
        assert (10.0 ** tree.score(code)).sum() == pytest.approx(1, abs=1e-4)
    assert sum(len(e) for e in tree.escapes) > 5


def brute_scores(rows, order, share):
    """The model by its definition, with dictionaries: whole text probabilities of all rows."""
    base = brute(rows)
    count = Counter(w for (_, t), b in zip(rows, base, strict=True) if not b[1] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    seen = [Counter() for _ in range(order + 1)]
    for (_, t), b in zip(rows, base, strict=True):
        if not b[1]:
            stream = b"\n" * order + b" ".join(tokens(t))
            for i in range(order, len(stream)):
                for k in range(order + 1):
                    seen[k][stream[i - k : i + 1]] += 1
    total = sum(seen[0].values())
    least = max(1.0, share * total)
    contexts = [Counter() for _ in range(order + 1)]
    for k in range(order + 1):
        for g, c in seen[k].items():
            contexts[k][g[:-1]] += c
    states = {}

    def rest(ctx):
        kept = [c for s in range(256) if (c := seen[len(ctx)].get(ctx + bytes([s]), 0)) >= least]
        return contexts[len(ctx)][ctx] - sum(c - lm.DISCOUNT for c in kept)

    def is_state(ctx):
        if ctx not in states:
            own, gain, kept = contexts[len(ctx)][ctx], 0.0, 0
            states[ctx] = False
            if own >= least:
                for s in range(256):
                    if (c := seen[len(ctx)].get(ctx + bytes([s]), 0)) >= least:
                        parent = prob(ctx[1:], s)
                        gain += c * math.log10((c - lm.DISCOUNT + rest(ctx) * parent) / own / parent)
                        kept += c
                states[ctx] = kept > 0 and gain + (own - kept) * math.log10(rest(ctx) / own) >= lm.MIN_GAIN * least / math.log(10)
        return states[ctx]

    def prob(ctx, s):
        if not ctx:
            c = seen[0].get(bytes([s]), 0)
            return ((c if c >= least else 0) + lm.FLOOR) / (total + 256 * lm.FLOOR)
        shorter = prob(ctx[1:], s)
        if not is_state(ctx):
            return shorter
        c = seen[len(ctx)].get(ctx + bytes([s]), 0)
        return ((c - lm.DISCOUNT if c >= least else 0) + rest(ctx) * shorter) / contexts[len(ctx)][ctx]

    def score(t):
        sum_, tail = 0.0, b"\n" * order
        for w in tokens(t):
            spelled = 1.0
            for s in w if w == b"\n" else w + b" ":
                spelled *= prob(tail, s)
                tail = tail[1:] + bytes([s])
            sum_ += math.log10(lm.ROOT * (count[w] + 1) / (n + v + 1) + (1 - lm.ROOT) * spelled)
        return sum_

    return [score(t) for _, t in rows]


@pytest.mark.parametrize("share", [0.0, 2e-3])
def test_scores_equal_brute_force(spark, share):
    rng = np.random.default_rng(4)
    words = ["the", "river", "Walks", "of", "r\u00edo", "tion", *(f"r{i}" for i in range(30))]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 25)))) for i in range(40)] + [(40, None), (41, "\u65e5\u672c zzz")]
    got = lm.score(documents(spark, [(*r, "en", "s") for r in rows]), *lm.learn(documents(spark, [(*r, "en", "s") for r in rows]), share)).collect()
    assert [r.score for r in sorted(got, key=lambda r: r.doc_id)] == pytest.approx(brute_scores(rows, lm.ORDER, share), abs=1e-3)


def test_hard_rows(spark):
    docs = documents(spark, HARD)
    check(docs, [r[:2] for r in HARD])
    assert lm.score(docs.limit(0), *lm.learn(docs.limit(0))).count() == 0
