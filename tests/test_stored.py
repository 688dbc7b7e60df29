"""Stored merges: only what changes is written, and a run that fails leaves the old rows or is carried on."""

import random

import pytest
from pyspark.sql import functions as F

from contestlab.sources import stored
from contestlab.sources.stored import StoredTable

SCHEMA = "k long, place string, v int, reviewed boolean"


def rows_of(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i % 5}", i, i % 3 == 0) for i in range(200)] + [(None, None, 1, None)], SCHEMA)
    return StoredTable.create(df, str(tmp_path / "t"), ["k"], buckets=8)


def test_merges_equal_a_dictionary(spark, tmp_path):
    rng, now, without = random.Random(1), {}, []
    table = StoredTable.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "t"), ["k"], buckets=4)
    for step in range(6):
        changes = [(rng.choice([None, *range(30)]), f"s{step}", rng.randrange(100), rng.random() < 0.4) for _ in range(12)]
        changes = [*{c[0]: c for c in changes}.values()]
        guarded = step % 2 == 1
        df = spark.createDataFrame(changes, SCHEMA)
        table.upsert(df, ~F.col("reviewed") if guarded else None)
        for c in changes:
            if c[0] is None:  # equals no other
                without.append(c)
            elif not guarded or c[0] not in now or now[c[0]][3] is False:
                now[c[0]] = c
        gone = [(rng.randrange(30),)]
        table.delete(spark.createDataFrame(gone, "k int"))
        now.pop(gone[0][0], None)
        assert rows_of(table) == sorted([*now.values(), *without], key=str)
    again = StoredTable(spark, str(tmp_path / "t"))
    assert rows_of(again) == sorted([*now.values(), *without], key=str) and (again.keys, again.buckets) == (["k"], 4)


def test_untouched_files_keep_their_names(spark, tmp_path, table):
    before = files(tmp_path / "t")
    touched = table.upsert(spark.createDataFrame([(7, "new", -1, False), (1000, "new", -2, False)], SCHEMA))
    after = files(tmp_path / "t")
    same = lambda names: {n for n in names if int(n.split("/")[0].split("=")[1]) not in touched}
    assert 1 <= len(touched) <= 2 and same(before) == same(after) and len(same(before)) >= 6
    assert not (before - same(before)) & after  # what was touched is new
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(("_staged", "_old", "_swap"))]
    assert table.upsert(spark.createDataFrame([], SCHEMA)) == [] and files(tmp_path / "t") == after


def test_only_touched_folders_are_read(spark, table):
    own = table._rows().filter(F.col(stored.BUCKET).isin([1, 2]))
    assert "PartitionFilters: [isnotnull" in (plan := own._jdf.queryExecution().executedPlan().toString()) or "PartitionFilters: [_bucket" in plan
    assert {f.split(f"{stored.BUCKET}=")[1][0] for f in own.inputFiles()} <= set("01234567")


def test_replacing_a_key_of_many_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i % 5}", i, None) for i in range(100)], SCHEMA)
    table = StoredTable.create(df, str(tmp_path / "t"), ["place"], buckets=8)
    table.replace(spark.createDataFrame([(1, "p1", -1, None), (2, "p1", -2, None), (3, "p9", -3, None)], SCHEMA))
    want = [(i, f"p{i % 5}", i, None) for i in range(100) if i % 5 != 1] + [(1, "p1", -1, None), (2, "p1", -2, None), (3, "p9", -3, None)]
    assert rows_of(table) == sorted(want, key=str)
    table.delete(spark.createDataFrame([("p9",), ("p0",)], "place string"))
    assert rows_of(table) == sorted((w for w in want if w[1] not in ("p9", "p0")), key=str)


def test_a_run_that_fails_leaves_the_old_rows(spark, tmp_path, table, monkeypatch):
    before, names = rows_of(table), files(tmp_path / "t")
    bad = spark.createDataFrame([(7, "x", 1, True)], SCHEMA).withColumn("v", F.expr("assert_true(k != 7, 'no')").cast("int"))
    with pytest.raises(Exception, match="no"):
        table.upsert(bad)
    assert rows_of(table) == before and files(tmp_path / "t") == names

    def fails(self, name, value):
        raise OSError("full")

    monkeypatch.setattr(stored._Files, "write", fails)
    with pytest.raises(OSError, match="full"):
        table.upsert(spark.createDataFrame([(7, "x", 1, True)], SCHEMA))
    assert rows_of(StoredTable(spark, str(tmp_path / "t"))) == before and files(tmp_path / "t") == names


@pytest.mark.parametrize("moves", [0, 1, 2, 3, 5])
def test_a_swap_that_is_cut_short_is_carried_on(spark, tmp_path, table, monkeypatch, moves):
    want = sorted([*(r for r in rows_of(table) if r[0] not in (1, 2, 3, 4, 5)), *((i, "new", -i, True) for i in (1, 2, 3, 4, 5))], key=str)
    plain, left = stored._Files.move, [moves + 1]  # the first renames the note

    def some(self, name, to):
        left[0] -= 1
        if left[0] < 0:
            raise OSError("lost")
        plain(self, name, to)

    with monkeypatch.context() as m:
        m.setattr(stored._Files, "move", some)
        with pytest.raises(OSError, match="lost"):
            table.upsert(spark.createDataFrame([(i, "new", -i, True) for i in (1, 2, 3, 4, 5)], SCHEMA))
    assert rows_of(StoredTable(spark, str(tmp_path / "t"))) == want
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(("_staged", "_old", "_swap"))]


def test_what_a_table_must_have(spark, tmp_path, table):
    df = spark.createDataFrame([(1, "a", 1, True)], SCHEMA)
    for wrong in ((df, ["none"]), (df, []), (df.withColumn(stored.BUCKET, F.lit(1)), ["k"])):
        with pytest.raises(ValueError):
            StoredTable.create(wrong[0], str(tmp_path / "x"), wrong[1])
    with pytest.raises(FileExistsError):
        StoredTable.create(df, str(tmp_path / "t"), ["k"])
