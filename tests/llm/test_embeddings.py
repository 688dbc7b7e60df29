import numpy as np

from contestlab.llm import ann, embdedup

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, t string, size string"
ODD = [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [1.0, None] * 4, 1), (904, [1.0] * 8, None), (905, [float("inf")] * 8, 1), (906, [1.0] * 3, 1), (907, [], 1)]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], b, "c", "d", "e") for i, e, b in rows], SCHEMA)


def vectors(n=260, seed=1):
    rng = np.random.default_rng(seed)
    base, rows = rng.normal(size=(12, 8)), []
    for i in range(n):
        x = base[i % 12] + rng.normal(size=8) * (0.0 if i % 5 == 0 else 0.12)
        rows.append((i, x.astype(np.float32).tolist(), i % 3))
    return rows + [(5, rows[5][1], 2), (6, rows[6][1], 0)]


def brute(rows, live):
    x = [np.array(e, np.float64) if k else None for (_, e, _), k in zip(rows, live, strict=True)]
    n, comp = len(rows), [r[0] for r in rows]
    link = [[i != j and live[i] and live[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.98 for j in range(n)] for i in range(n)]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if link[i][j] and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return sorted((r[0], sum(map(bool, k)), c, r[0] == c) for r, k, c in zip(rows, link, comp, strict=True))


def test_dedup_equals_brute_force(spark):
    rows = vectors() + ODD
    live = [i < len(rows) - len(ODD) or r[0] == 906 for i, r in enumerate(rows)]
    want = brute(rows, live)
    assert sum(w[1] for w in want) > 100
    for block in (2048, 16):
        got = embdedup.near_duplicates(frame(spark, rows), block=block)
        assert sorted(map(tuple, got.collect())) == want
    assert embdedup.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    assert embdedup.near_duplicates(frame(spark, [(None, [1.0] * 8, 1)] * 2)).filter("component_id is null and n_links = 0 and not kept is null").count() == 2


def top(rows, queries, k=20):
    out = {}
    for q, e in queries:
        near = {}
        for i, x, _ in rows:
            if i != q:
                s = float(np.dot(np.array(e, np.float64), np.array(x, np.float64)))
                near[i] = max(near.get(i, -np.inf), s)
        out[q] = sorted(near, key=lambda i: (-near[i], i))[:k]
    return out


def test_search_recall_order_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), 1) for i in range(3000)] + [(3000 + i, [3.0] * 16, 1) for i in range(150)]
    df = frame(spark, rows)
    got = ann.search(df, df.filter("vec_id % 60 = 0")).collect()
    want = top(rows, [r[:2] for r in rows if r[0] % 60 == 0])
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(want) and all([r["rank"] for r in v] == list(range(1, 21)) for v in by.values())
    assert np.mean([len(set(want[q]) & {r.vec_id for r in v}) / 20 for q, v in by.items()]) >= 0.9
    assert [r.vec_id for r in by[3000]] == list(range(3001, 3021))


def test_search_hard_rows(spark):
    rows = [(i, [1.0, float(i)], 1) for i in range(7)] + [(3, [1.0, 3.0], 1)] + [(i, e and e[:2], b) for i, e, b in ODD]
    df = frame(spark, [r for r in rows if r[0] not in (904, 905, 906)] + [(5, [2.0, 1.0, 1.0], 1), (90, [1.0, 1.0, 1.0], 1)])
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, df.filter("vec_id % 5 = 0")).collect()]
    assert sorted(got)[:3] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0)]
    assert len(got) == 14 and [g[2] for g in sorted(got) if g[0] == 5 and g[2] < 90] == [6, 4, 3, 2, 1, 0]
    assert (5, 1, 90, 4.0) in got and (90, 1, 5, 4.0) in got  # vectors of another length among themselves
    assert ann.search(df.limit(0), df).count() == 0 == ann.search(df, df.limit(0)).count()


def test_search_finds_all_on_other_rows(spark):
    """Tight crowds, very unequal lengths and far apart magnitudes: codes can't tell such rows apart, bounds can."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(8, 16))
    crowd = [(base[i % 8] * (1 + i % 3) + rng.normal(size=16) * 1e-3).tolist() for i in range(2400)]
    lengths = [(rng.normal(size=16) * 10.0 ** rng.uniform(-3, 3)).tolist() for _ in range(800)]
    shifted = [(rng.normal(size=16) * 0.05 + 100).tolist() for _ in range(800)]
    for vectors in (crowd, lengths, shifted, [[x * 1e30 for x in v] for v in lengths], crowd + lengths + shifted):
        rows = [(i, np.array(v, np.float64).astype(np.float32).tolist(), 1) for i, v in enumerate(vectors)]
        df = frame(spark, rows)
        want = top(rows[:], [r[:2] for r in rows if r[0] % 200 == 0])
        got = {}
        for r in ann.search(df, df.filter("vec_id % 200 = 0")).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert np.mean([len(set(want[q]) & got[q]) / 20 for q in want]) > 0.999
