"""Joins over time against loops."""

import random
from datetime import date, timedelta

from contestlab.operators.temporal import as_of, in_windows

DAY = date(2020, 1, 1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_last_revision(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, None]), DAY + timedelta(days=rng.randrange(40)), i) for i in range(200)]
    revisions = [(rng.choice([1, 2, None]), DAY + timedelta(days=rng.randrange(40)), rng.choice([None, 5, 6])) for _ in range(40)]
    a, b = spark.createDataFrame(rows, "k int, day date, i int"), spark.createDataFrame(revisions, "k int, day date, v int")
    for strict in (False, True):
        want = []
        for k, day, i in rows:
            found = [(d, v is not None, v or 0, v) for q, d, v in revisions if q == k and (d < day if strict else d <= day)]
            want.append((k, day, i, max(found)[3] if found else None))
        assert rows_of(as_of(a, b, ["k"], "day", ["v"], before=strict)) == sorted(want, key=str)
    plan = as_of(a, b, ["k"], "day", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Window [last") == 1


def test_windows_that_overlap(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), DAY + timedelta(days=rng.randrange(-30, 90)), i) for i in range(300)]
    windows = []
    for n in range(60):
        first = DAY + timedelta(days=rng.randrange(-20, 80))
        windows.append((rng.choice([1, 2, 3]), n, rng.choice([first, first, None]), first + timedelta(days=rng.choice([0, 1, 3, 10, 50]))))
    a, b = spark.createDataFrame(rows, "k int, day date, i int"), spark.createDataFrame(windows, "k int, w int, first date, last date")
    got = sorted((r.i, r.w) for r in in_windows(a, b, ["k"], "day", "first", "last").collect())
    assert got == sorted((i, w) for k, day, i in rows for q, w, first, last in windows if k == q and first is not None and first < day <= last)
    assert in_windows(a, b.limit(0), ["k"], "day", "first", "last").count() == 0


def test_pairs_met_are_about_as_many_as_matches(spark):
    """1,000 windows of a key, one after another: a row meets two of them at most, not all."""
    windows = spark.createDataFrame([(1, n, DAY + timedelta(days=10 * n), DAY + timedelta(days=10 * n + 10)) for n in range(1000)], "k int, w int, first date, last date")
    rows = spark.createDataFrame([(1, DAY + timedelta(days=n % 10_000 + 1), n) for n in range(20_000)], "k int, day date, i int")
    found = in_windows(rows, windows, ["k"], "day", "first", "last")
    assert found.count() == 20_000
    met = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" in met
    bins = {}
    for n in range(1000):
        for b in range((18262 + 10 * n + 1) // 10, (18262 + 10 * n + 10) // 10 + 1):
            bins[b] = bins.get(b, 0) + 1
    assert max(bins.values()) <= 2


def test_last_rolls_are_whole(spark):
    """The as-of query gives all that the changes' page gives."""
    from contestlab.queries import relational as R

    folder = "/root/testdata/sf0.001"
    a, b = R.QUERIES["join_asof_lateral"](spark, folder), R.QUERIES["q_roll_changes"](spark, folder)
    assert a.columns == b.columns and a.exceptAll(b).count() == 0 == b.exceptAll(a).count() and R.SQL["join_asof_lateral"] == R.SQL["q_roll_changes"]
