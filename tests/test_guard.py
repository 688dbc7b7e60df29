"""The SQL guard: what passes, what is turned away, whose views are touched, and when a query is ended."""

import time

import pytest
from pyspark.sql import functions as F

from contestlab.operators import guard

PASSING = {
    "with x as (select i from wide) select max(i) as m from x union select 7 limit 1": 1,
    "select * from wide;": 2,
    "SELECT * FROM WIDE -- all of it": 2,
    "with wide as (select 1 as y) select * from wide": 1,
    "with a as (select i from wide), b as (select i from a where i > 1) select * from b join a using (i)": 1,
    "select * from wide w where exists (select 1 from tall t where t.i = w.i) and w.i in (select i from tall)": 1,
    "select s, rank() over (partition by s order by i desc nulls last) as r, round(avg(i) over (), 2) as a from wide": 2,
    "select case when i > 1 then 'x' else upper(s) end as c, cast(i as string) || '!' as d, i between 1 and 2 as e, s like 'a%' as f from wide order by 1": 2,
    "select s, count(*) as n, sum(i) filter (where i > 1) as m from wide group by rollup(s) having count(*) > 0": 3,
    "select (select max(i) from tall) as m, date '2024-01-01' as d, extract(year from date '2024-01-01') as y": 1,
    "select * from (values (1, 2), (3, 4)) v(a, b) except select 3, 4": 1,
    "select t.i, x.n from tall t cross join lateral (select count(*) as n from wide w where w.i = t.i) x": 1,
    "select sum(i) over w as n from wide window w as (order by i)": 2,
    "select i from wide order by i limit 1 offset 1": 1,
}
REJECTED = [
    "",
    " ; ",
    "select 1; select 2",
    "select 1; drop table wide",
    "drop table wide",
    "insert into wide select 1, 'a'",
    "update wide set i = 1",
    "delete from wide",
    "create table x as select 1",
    "create temporary view wide as select 1",
    "alter table wide add column x int",
    "truncate table wide",
    "merge into wide using tall on wide.i = tall.i when matched then delete",
    "set x = 1",
    "show tables",
    "describe wide",
    "explain select * from wide",
    "cache table wide",
    "use other",
    "add jar 'x.jar'",
    "select * from secret",
    "select * from other.wide",
    "select * from spark_catalog.default.wide",
    "select * from global_temp.secret",
    "select * from parquet.`/tmp/x`",
    "table secret",
    "from secret select *",
    "from wide |> where i > 1",
    "select i from wide where i in (select x from secret)",
    "select (select max(x) from secret)",
    "select * from wide where exists (select 1 from secret)",
    "select * from wide, lateral (select * from secret)",
    "select i from wide union all select x from secret",
    # names given by WITH count only where they can be seen
    "with secret as (select * from secret) select * from secret",
    "select u.x from (with secret as (select 1 as y) select * from secret) t join secret u on true",
    "with a as (select * from b), b as (select 1 as x) select * from a",
    "with a as (with secret as (select 1 as x) select * from secret) select * from a, secret",
    "with recursive r as (select 1 as n union all select n + 1 from r where n < 9) select * from r",
    # names that are put together
    "select * from identifier('secret')",
    "select * from identifier('wi' || 'de')",
    "select identifier('upper')(s) from wide",
    # functions
    "select java_method('java.lang.System', 'exit', '1')",
    "select reflect('java.lang.System', 'getenv', 'HOME') from wide",
    "select input_file_name() from wide",
    "select other.upper(s) from wide",
    "select * from range(10)",
    "select explode(array(1))",
    "select * from wide lateral view explode(array(1)) e as y",
    "select transform(i) using 'cat' as (x string) from wide",
    "select current_user() from wide",
    "select current_user from wide",
    "select current_catalog, session_user from wide",
    "select transform(array(1), x -> x + 1)",
    "select * from wide where i = :n",
    "select /*+ broadcast(wide) */ * from wide",
    "select nothing from wide",
]


@pytest.fixture(scope="module")
def tables(spark):
    spark.createDataFrame([("hidden",)], "x string").createOrReplaceTempView("secret")
    spark.createDataFrame([("mine",)], "x string").createOrReplaceTempView("wide")
    return {"wide": spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string"), "Tall": spark.createDataFrame([(2,)], "i int")}


@pytest.mark.parametrize("sql", PASSING)
def test_reads_pass(spark, tables, sql):
    assert guard.run(spark, sql, tables, seconds=60).count() == PASSING[sql]


@pytest.mark.parametrize("sql", REJECTED)
def test_all_else_is_rejected(spark, tables, sql):
    with pytest.raises(guard.Rejected):
        guard.run(spark, sql, tables)


def test_the_second_wall_holds_by_itself(spark, tables):
    """Analysed where only the allowed views are, a forbidden view can't be resolved; leaves of other kinds are turned away."""
    own = guard.isolated(spark, {"wide": tables["wide"]})
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        own.sql("with secret as (select * from secret) select * from secret")
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        own.sql("select * from identifier('secret')")
    for sql in ("select * from range(3)", "select current_user from wide"):
        with pytest.raises(guard.Rejected):
            guard._check_leaves(own.sql(sql)._jdf.queryExecution().analyzed(), frozenset({"wide"}))
    with pytest.raises(guard.Rejected):
        guard._check_leaves(own.sql("select * from wide")._jdf.queryExecution().analyzed(), frozenset({"tall"}))


def test_limits(spark, tables):
    got = guard.guard(spark, "select i from wide", tables)
    assert (got.tables, got.limit, got.rewritten) == (["wide"], 500, True)
    assert (guard.guard(spark, "select i from wide limit 10", tables).limit, guard.guard(spark, "select i from wide limit 10", tables).rewritten) == (10, False)
    assert guard.guard(spark, "select i from wide limit 100000", tables).limit == 500
    assert guard.guard(spark, "select i from wide union select 1 limit 7", tables).limit == 7
    assert guard.run(spark, "select * from wide", tables, max_rows=1).count() == 1


def test_views_of_the_caller_stay(spark, tables):
    guard.run(spark, "select * from wide", tables)
    assert [r.x for r in spark.sql("select * from wide").collect()] == ["mine"]
    assert {t.name for t in spark.catalog.listTables()} >= {"wide", "secret"} and not any(t.name == "tall" for t in spark.catalog.listTables())


def test_settings_of_the_caller_hold(spark, tables):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert guard.isolated(spark, {}).conf.get("spark.sql.session.timeZone") == "Asia/Kolkata"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_slow_query_is_ended(spark, tables):
    many = {"many": spark.range(0, 10_000_000, 1, 4).select(F.col("id").alias("i"))}
    t = time.monotonic()
    with pytest.raises(guard.TooSlow):
        guard.run(spark, "select count(*) from many a join many b on a.i % 7 < b.i", many, seconds=2)
    assert time.monotonic() - t < 20
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert guard.run(spark, "select count(*) as n from many", many, seconds=60).first().n == 10_000_000
