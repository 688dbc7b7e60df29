"""Queries against their SQL on the smallest data, and the entry module's contract."""

import json
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from contestlab import queries as core
from contestlab.queries import results
from contestlab.queries.derived import star_views

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
#: All views, and some of every other kind; TEST_ALL=1 takes every query.
SOME = ("mv_", "v_pc", "setop", "q_summary", "q_acs", "q_roll", "q_priority", "alliance", "crib_3", "hash_", "xwalk_match", "uid_mint", "blend_surname", "scen_project", "vec_search", "q_news_issues", "q_budget", "q_local_results", "metric_priority_score", "percentile", "dq_roll", "dq_constraints", "join_", "agg_corr", "form20", "ls_segment", "roll_scan", "resolve_column", "top3", "area_", "guard_sql", "sink_", "stream_tumbling", "stream_budget", "stream_dedupe", "blend_booth", "q_surnames", "geo_", "scan_feed", "late_data", "dq_pii", "str_translit", "str_building", "scen_monte", "topk_variance", "q_card")
NAMES = [n for n in core.oracle_sql() if os.environ.get("TEST_ALL") or n.startswith(SOME)]

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = core.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(core.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == want


def test_entry_and_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_cards_hold_what_the_views_hold(spark):
    views = star_views(spark, str(DATA))
    wide = {}
    for r in views.wide.filter("unit_id in (1, 2)").collect():
        wide.setdefault(r.unit_id, []).append((r.year, r.kind, r.valid_votes, r.winner_party, r.margin_votes))
    rows = {r.unit_id: r for r in results.card(views, [1, 2]).collect()}
    assert set(rows) == {1, 2}
    for unit, r in rows.items():
        got = [(x["year"], x["kind"], x["valid_votes"], x["winner_party"], x["margin_votes"]) for x in json.loads(r.results or "[]")]
        assert sorted(got) == sorted(wide.get(unit, [])) and [x[0] for x in got] == sorted((x[0] for x in got), reverse=True)
        assert r.results is not None or "no results loaded" in r.caveats
        assert ("lineage: " in r.caveats) == (r.lineage_kind is not None)


def test_plans_push_down_and_prune(spark):
    """The baseline's filter reaches the scan of what it is about, and no scan reads columns that nothing needs."""
    plan = core.queries()["filt_date_window"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderdate" in plan
    wide = core.queries()["mv_result_booth_wide"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in wide and "l_discount" not in wide and "Python" not in wide
