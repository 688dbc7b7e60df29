"""Views that are stored by unit are read by unit: after the first, steps by unit shuffle nothing."""

import re

import pytest

from contestlab.model import from_star
from contestlab.operators.quality import digest
from contestlab.plans import views as V
from contestlab.plans.graph import define_views

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def sorted_joins(spark):
    """Joins as on large tables: none by broadcast but where a hint says so."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_same_rows_in_one_file_a_bucket(spark, tmp_path, sorted_joins):
    data = from_star(spark, DATA, few=0)
    assert data.unit_tasks == 4 and from_star(spark, DATA).unit_tasks == 0
    define_views(spark, data).run(str(tmp_path / "dealt"))
    define_views(spark, from_star(spark, DATA)).run(str(tmp_path / "plain"))
    for name in V.ORDER:
        a, b = (digest(spark.read.parquet(f"{tmp_path}/{where}/{name}")).first() for where in ("dealt", "plain"))
        assert a == b, name
    for name in V.BY_UNIT:
        assert len(list((tmp_path / "dealt" / name).glob("part-*"))) == 4, name
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("stored_")]


def test_steps_by_unit_need_no_shuffle(spark, tmp_path, sorted_joins):
    views = V.Views(from_star(spark, DATA, few=0))
    V.refresh(views, str(tmp_path), V.BY_UNIT)
    again = V.Views(views.data)
    again.lie_by_unit = True
    again.__dict__.update({n: views.__dict__[n] for n in V.BY_UNIT})
    fresh = lambda name: vars(V.Views)[name].func(again)._jdf.queryExecution().executedPlan().toString()
    for name in ("result_party", "totals", "party_share", "transfer", "floating_vote", "volatility"):
        assert "Exchange" not in fresh(name), name
    for name in ("wide", "swing", "swing_vanished"):  # only the units, and the few contests
        shuffled = re.findall(r"Exchange hashpartitioning\((.*), \d+\)", fresh(name))
        assert {re.sub(r"#\w+", "", s) for s in shuffled} <= {"unit_id", "c_nationkey", "n_nationkey", "group_id, kind", "kind, year"}, name
