"""Titles of a stream are hashed once, and compared by quarters of their hashes."""

from unittest import mock

import numpy as np

from contestlab.queries import intake
from contestlab.streaming import state


def test_arrivals_are_cut_from_stored_hashes(spark):
    class Seen(Exception):
        pass

    def look(spark, rows, *_):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        raise Seen("EvalPython" in plan)

    with mock.patch.object(intake, "_arrivals", look):
        try:
            intake.stream_dedupe_titles(spark, "/root/testdata/sf0.001")
        except Seen as seen:
            assert seen.args == (False,)


def test_each_near_pair_of_a_quarter_is_compared():
    rng = np.random.default_rng(3)
    for quarter in range(4):
        shift = 48 - 16 * quarter
        clear = ~(0xFFFF << shift) & (1 << 64) - 1
        known = [int(h) & clear | 0xBEE << shift for h in rng.integers(0, 1 << 63, 300, np.uint64)]
        known += [h ^ sum(1 << int(b) for b in rng.choice([b for b in range(64) if not shift <= b < shift + 16], 3, False)) for h in known[:200]]
        hashes = np.array(known, np.uint64)
        near = {(a, b) for a in range(100, 500) for b in range(500) if (known[a] ^ known[b]).bit_count() <= 3}
        with mock.patch.object(state, "PAIRS", 1000):
            found, most = set(), 0
            for i, j in state._to_compare(hashes[100:], hashes, quarter):
                found |= set(zip((i + 100).tolist(), j.tolist(), strict=True))
                most = max(most, len(i))
        assert near <= found and len(found) < 4_000 and most <= 1500
