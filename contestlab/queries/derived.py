"""The derived views themselves, over the star-schema data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contestlab.model import from_star
from contestlab.plans.view_sql import over_views
from contestlab.plans.views import Views

#: query: view
NAMES = {
    "mv_result_booth_candidate": "result_candidate",
    "mv_result_booth_party": "result_party",
    "mv_booth_totals": "totals",
    "mv_booth_party_share": "party_share",
    "mv_result_booth_wide": "wide",
    "mv_swing": "swing",
    "mv_swing_vanished": "swing_vanished",
    "setop_swing_all": "swing_all",
    "mv_transfer_ls_vs": "transfer",
    "mv_floating_vote": "floating_vote",
    "mv_volatility": "volatility",
    "mv_new_voter_share": "new_voter_share",
    "mv_booth_priority": "priority",
    "mv_area_rollup": "area_rollup",
    "mv_ac_summary": "group_summary",
    "v_pc_candidate_segments": "joint_segments",
}


def star_views(spark: SparkSession, sf_dir: str, **options) -> Views:
    return Views(from_star(spark, sf_dir), **options)


def _view(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views = star_views(spark, sf_dir)
        return views.held_by(getattr(views, name))

    return query


QUERIES = {query: _view(view) for query, view in NAMES.items()}
SQL = {query: over_views(f"SELECT * FROM {view}") for query, view in NAMES.items()}
