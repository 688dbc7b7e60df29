"""The metric functions as SQL functions over the views, and the input checks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlab.functions import metrics as M
from contestlab.operators import quality as Q
from contestlab.plans.graph import define_views
from contestlab.plans.view_sql import MARGIN, SIGNED, over_views, pct, rounded, score
from contestlab.plans.views import ORDER, percent_ranks_in
from contestlab.shared import shared_dir, written

from .derived import star_views
from .texts import read

KEY = ("contest_id", "unit_id")


def _wide(expression: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        M.register(spark)
        return star_views(spark, sf_dir).wide.selectExpr(*KEY, f"{expression} AS value")

    return query


def _of(view: str, *keys: str, value: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        M.register(spark)
        return getattr(star_views(spark, sf_dir), view).selectExpr(*keys, f"{value} AS value")

    return query


def swing_check(spark, sf_dir):
    M.register(spark)
    return star_views(spark, sf_dir).swing.selectExpr(*KEY, "party", "metric_comparison_allowed(confidence, reviewed, lineage_kind, false) AS allowed", "metric_swing_pct(share_pct, prev_share_pct, confidence, reviewed, lineage_kind, false) AS value")


def volatility_check(spark, sf_dir):
    M.register(spark)
    rows = star_views(spark, sf_dir).wide.filter("kind = 'VS'").groupBy("unit_id").agg(F.sort_array(F.collect_list("signed_margin_pct")).alias("m"))  # one a contest
    return rows.selectExpr("unit_id", "CAST(round(metric_volatility(m), 1) AS DOUBLE) AS value")


def _inputs():
    x = {"c": "CASE WHEN contest_id % 7 != 0 THEN (unit_id % 101) / 100D END", "n": "CASE WHEN unit_id % 5 != 0 THEN (unit_id % 41) / 40D END", "f": "CASE WHEN unit_id % 3 != 0 THEN (unit_id % 11) / 10D END", "v": "CASE WHEN unit_id % 4 != 0 THEN (unit_id % 9) / 8D END"}
    return x, {k: "(" + e.replace("D END", ".0::DOUBLE END") + ")" for k, e in x.items()}


_X, _Y = _inputs()
_WEIGHT, _SCORE = score(list(_Y.values()))


def percentile_ranks(spark, sf_dir):
    rows = star_views(spark, sf_dir).wide.select(*KEY, "margin_pct")
    return percent_ranks_in(rows, "contest_id", list(KEY), {"margin_pct": "value"}).select(*KEY, "value")


def published(spark, sf_dir):
    """Totals by contest and party, a few of them off on purpose."""
    v = star_views(spark, sf_dir)
    off = ((F.col("contest_id") % 100 == 11) & (F.col("party") == "NOTA")).cast("int")
    return v, v.result_candidate.groupBy("contest_id", "party").agg(F.sum("votes").alias("votes")).select("contest_id", "party", (F.col("votes") + off).alias("votes"))


def dq_ac_totals(spark, sf_dir):
    v, totals = published(spark, sf_dir)
    return Q.totals_differ(v.result_candidate, totals, ["contest_id", "party"])


def dq_row_arith(spark, sf_dir):
    v = star_views(spark, sf_dir)
    printed = v.totals.select(*KEY, (F.col("valid_votes") + (F.col("unit_id") % 97 == 3).cast("int")).alias("total_valid"))
    return Q.rows_differ(v.result_candidate, printed, list(KEY))


def dq_coverage(spark, sf_dir):
    v = star_views(spark, sf_dir)
    return Q.orphans(v.result_candidate, v.data.units.filter("unit_id % 10 != 4").select("unit_id"), ["unit_id"], ["contest_id"])


def dq_quality(spark, sf_dir):
    return Q.link_quality(star_views(spark, sf_dir).data.units, ["group_id", "area_id"], 40.0)


def dq_continuity(spark, sf_dir):
    d = star_views(spark, sf_dir).data
    return Q.roll_gaps(d.snapshots.filter((F.col("unit_id") + F.dayofmonth("day")) % 17 != 0), d.units)


def dq_pii(spark, sf_dir):
    return Q.personal_data(read(spark, sf_dir, "documents"), "documents")


def dq_columns(spark, sf_dir):
    tables = {t: read(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")}
    c = tables["customer"]
    tables["roll"] = c.select("c_custkey", F.col("c_name").alias("Voter_Name"), F.col("c_nationkey").alias("house_no"), F.col("c_mktsegment").alias("part"))  # as a roll would be
    found = Q.forbidden_columns(tables)
    return spark.createDataFrame(found, "table string, column string")


def dq_screen(spark, sf_dir):
    return Q.screen(read(spark, sf_dir, "documents"), "text")[0].select("doc_id")


def dq_confidence(spark, sf_dir):
    return Q.low_confidence(star_views(spark, sf_dir).data.units, 0.8)


def dq_constraints(spark, sf_dir):
    rules = {"quantity": F.col("l_quantity") >= 10, "discount": F.col("l_discount").between(0, 0.05), "flag": F.col("l_returnflag").isin("A", "N", "R")}
    return Q.violations(read(spark, sf_dir, "lineitem"), rules, ["l_orderkey"])


def dq_refreshed_twice(spark, sf_dir):
    """All views stored twice, each time from those stored before them: the rows of each, and whether they are the same."""
    digests = []
    for _ in range(2):
        path = f"{shared_dir(spark)}/refreshed-{uuid.uuid4().hex}"
        define_views(spark, star_views(spark, sf_dir).data).run(path)
        each = [Q.digest(spark.read.parquet(f"{path}/{name}")).select(F.lit(name).alias("view"), "rows", "digest") for name in ORDER]
        digests.append(written(reduce(DataFrame.unionByName, each), "digests"))
    first, second = digests
    same = F.col("a.rows").eqNullSafe(F.col("b.rows")) & F.col("a.digest").eqNullSafe(F.col("b.digest"))
    return first.alias("a").join(second.alias("b"), "view", "left").select("view", "a.rows", same.alias("same"))


def notes(spark, sf_dir):
    """Customers with notes, of which four in five hold a number that must not be kept."""
    k, digits = F.col("c_custkey"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    card = F.concat(F.lit("ABC"), digits)
    phone = (F.lit(9_000_000_000) + k).cast("string")
    spaced = F.concat_ws(" ", F.lit("4321"), F.lpad((k % 10_000).cast("string"), 4, "0"), F.lit("8765"))
    note = F.element_at(F.array(F.concat(F.lit("card "), card), F.concat(F.lit("call "), phone, F.lit(" at noon")), F.concat(F.lit("no. "), spaced, F.lit(".")), F.concat(F.lit("seen, "), F.lower("c_mktsegment")), F.concat_ws("; ", phone, card, phone)), (k % 5 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select("c_custkey", note.alias("note"), F.col("c_mktsegment").alias("segment"))


def dq_notes(spark, sf_dir):
    return Q.personal_data(notes(spark, sf_dir), "notes")


def dq_screened_notes(spark, sf_dir):
    return Q.screen(notes(spark, sf_dir), "note")[0].select("c_custkey", "note")


QUERIES = {
    "metric_votes_polled": _wide("metric_votes_polled(valid_votes, rejected)"),
    "metric_turnout_pct": _wide("metric_turnout_pct(votes_polled, electors)"),
    "metric_share_pct": _wide("metric_share_pct(nota, valid_votes)"),
    "metric_margin_votes": _wide("metric_margin_votes(winner_votes, runner_votes, contestants)"),
    "metric_margin_pct": _wide("metric_margin_pct(winner_votes, runner_votes, contestants, valid_votes)"),
    "metric_signed_margin_pct": _wide("metric_signed_margin_pct(winner_party, winner_votes, runner_votes, contestants, valid_votes, party_a, party_b)"),
    "metric_swing_pct": swing_check,
    "metric_new_voter_pct": _of("new_voter_share", *KEY, value="metric_new_voter_pct(additions, electors)"),
    "metric_net_roll_change_pct": _of("new_voter_share", *KEY, value="metric_net_roll_change_pct(additions, deletions, electors_start)"),
    "metric_transfer_delta": _of("transfer", "year", "unit_id", "party", value="metric_transfer_delta(vs_share_pct, ls_share_pct)"),
    "metric_floating_pct": _of("floating_vote", "year", "unit_id", value="metric_floating_pct(floating_pct, poll_types)"),
    "metric_volatility": volatility_check,
    "metric_priority_weight": _wide(f"metric_priority_weight({', '.join(_X.values())})"),
    "metric_priority_score": _wide(f"metric_priority_score({', '.join(_X.values())})"),
    "percentile_ranks": percentile_ranks,
    "dq_ac_totals": dq_ac_totals,
    "dq_row_arith": dq_row_arith,
    "dq_crosswalk_coverage": dq_coverage,
    "dq_crosswalk_quality": dq_quality,
    "dq_roll_continuity": dq_continuity,
    "dq_pii_columns": dq_columns,
    "dq_pii_scan": dq_pii,
    "dq_pii_screen": dq_screen,
    "dq_confidence_share": dq_confidence,
    "dq_constraints": dq_constraints,
    "dq_refresh_idempotent": dq_refreshed_twice,
    "dq_pii_scan_notes": dq_notes,
    "dq_pii_screen_notes": dq_screened_notes,
}
_EPIC, _MOBILE, _AADHAAR = r"\b[A-Z]{3}[0-9]{7}\b", r"(?:^|[^0-9])[6-9][0-9]{9}(?:$|[^0-9])", r"(?:^|[^0-9])[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}(?:$|[^0-9])"
_V = lambda e: f"SELECT contest_id, unit_id, {e} AS value FROM wide"
SQL = {
    "metric_votes_polled": over_views(_V("valid_votes + coalesce(rejected, 0)")),
    "metric_turnout_pct": over_views(_V(pct("votes_polled", "electors"))),
    "metric_share_pct": over_views(_V(pct("nota", "valid_votes"))),
    "metric_margin_votes": over_views(_V(MARGIN)),
    "metric_margin_pct": over_views(_V(pct(f"({MARGIN})", "valid_votes"))),
    "metric_signed_margin_pct": over_views(_V(SIGNED)),
    "metric_swing_pct": over_views("SELECT contest_id, unit_id, party, coalesce(lineage_kind NOT IN ('split', 'merge'), true) AND (coalesce(reviewed, false) OR coalesce(confidence >= 0.85, false)) AS allowed, swing_pct AS value FROM swing"),
    "metric_new_voter_pct": over_views("SELECT contest_id, unit_id, new_voter_pct AS value FROM new_voter_share"),
    "metric_net_roll_change_pct": over_views("SELECT contest_id, unit_id, net_roll_change_pct AS value FROM new_voter_share"),
    "metric_transfer_delta": over_views("SELECT year, unit_id, party, delta_share_pct AS value FROM transfer"),
    "metric_floating_pct": over_views(f"SELECT year, unit_id, CASE WHEN poll_types = 2 THEN {rounded('(floating_pct / 2)')} END AS value FROM floating_vote"),
    "metric_priority_weight": over_views(_V(_WEIGHT)),
    "metric_priority_score": over_views(_V(_SCORE)),
    "metric_volatility": over_views(f"SELECT unit_id, round({rounded('stddev_samp(signed_margin_pct)')}, 1) AS value FROM wide WHERE kind = 'VS' GROUP BY 1"),
    "percentile_ranks": over_views("SELECT contest_id, unit_id, CASE WHEN margin_pct IS NOT NULL AND count(margin_pct) OVER (PARTITION BY contest_id) >= 2 THEN CAST(rank() OVER (PARTITION BY contest_id ORDER BY margin_pct NULLS LAST) - 1 AS DOUBLE) / (count(margin_pct) OVER (PARTITION BY contest_id) - 1) END AS value FROM wide"),
    "dq_ac_totals": over_views("SELECT contest_id, party, CAST(sum(votes) + 1 AS BIGINT) AS published, CAST(sum(votes) AS BIGINT) AS computed FROM result_candidate WHERE contest_id % 100 = 11 AND party = 'NOTA' GROUP BY 1, 2"),
    "dq_row_arith": over_views("SELECT contest_id, unit_id, valid_votes + 1 AS total_valid, valid_votes AS computed FROM totals WHERE unit_id % 97 = 3"),
    "dq_crosswalk_coverage": over_views("SELECT contest_id, count(DISTINCT unit_id) AS unlinked, CAST(sum(votes) AS BIGINT) AS votes_lost FROM result_candidate WHERE unit_id % 10 = 4 GROUP BY 1"),
    "dq_crosswalk_quality": over_views(f"SELECT * FROM (SELECT group_id, area_id, count(*) AS links, count(*) FILTER (confidence >= 0.85) AS sure, {pct('count(*) FILTER (confidence >= 0.85)', 'count(*)', 1)} AS sure_pct FROM units GROUP BY 1, 2) WHERE sure_pct < 40"),
    "dq_roll_continuity": over_views("""SELECT group_id, day, count(*) AS missing FROM (SELECT s.unit_id, u.group_id, s.day + 3 AS day FROM snapshots s JOIN units u USING (unit_id) WHERE (unit_id + day(s.day)) % 17 != 0) p
  WHERE p.day <= (SELECT max(day) FROM snapshots) AND (unit_id + day(p.day)) % 17 = 0 GROUP BY 1, 2""").replace("s.day + 3 AS day", "CAST(s.day + 3 AS DATE) AS day"),
    "dq_pii_columns": "SELECT 'roll' AS \"table\", unnest(['Voter_Name', 'house_no']) AS \"column\"",
    "dq_pii_scan": " UNION ALL ".join(
        f"""SELECT * FROM (SELECT 'documents' AS "table", '{c}' AS "column", '{name}' AS pattern, count(*) FILTER (n > 0) AS "values", CAST(coalesce(sum(n), 0) AS BIGINT) AS hits FROM (SELECT coalesce(len(regexp_extract_all(regexp_replace({c}, '([^0-9])', '\\1\\1', 'g'), '{p}')), 0) AS n FROM documents)) WHERE hits > 0"""
        for c in ("text", "lang", "source")
        for name, p in (("mobile", _MOBILE), ("aadhaar", r"(?:^|[^0-9])[0-9]{4}\s{0,2}[0-9]{4}\s{0,2}[0-9]{4}(?:$|[^0-9])"))
    )
    + " UNION ALL "
    + " UNION ALL ".join(f"""SELECT * FROM (SELECT 'documents', '{c}', 'epic', count(*) FILTER (n > 0) AS v, CAST(coalesce(sum(n), 0) AS BIGINT) AS h FROM (SELECT coalesce(len(regexp_extract_all({c}, '{_EPIC}')), 0) AS n FROM documents)) WHERE h > 0""" for c in ("text", "lang", "source")),
    "dq_pii_screen": f"SELECT doc_id FROM documents WHERE NOT coalesce(regexp_matches(text, '{_EPIC}|{_MOBILE}|{_AADHAAR}'), false)",
    "dq_confidence_share": over_views(f"SELECT * FROM (SELECT count(*) AS estimates, count(*) FILTER (confidence < 0.8) AS unsure, {pct('count(*) FILTER (confidence < 0.8)', 'count(*)', 1)} AS unsure_pct FROM units) WHERE unsure_pct >= 50"),
    "dq_constraints": """SELECT * FROM (SELECT 'quantity' AS rule, count(*) FILTER (l_quantity < 10) AS n FROM lineitem UNION ALL SELECT 'discount', count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.05::DOUBLE) FROM lineitem
  UNION ALL SELECT 'flag', count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) FROM lineitem UNION ALL SELECT 'unique l_orderkey', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) WHERE n > 0""",
    "dq_refresh_idempotent": over_views(" UNION ALL ".join(f"SELECT '{name}' AS view, count(*) AS rows, true AS same FROM {name}" for name in ORDER)),
    "dq_pii_scan_notes": """WITH n AS (SELECT c_custkey % 5 AS k FROM customer), c AS (SELECT 'notes' AS "table", 'note' AS "column", 'epic' AS pattern, count(*) FILTER (k IN (0, 4)) AS "values", count(*) FILTER (k IN (0, 4)) AS hits FROM n
  UNION ALL SELECT 'notes', 'note', 'mobile', count(*) FILTER (k IN (1, 4)), count(*) FILTER (k = 1) + 2 * count(*) FILTER (k = 4) FROM n UNION ALL SELECT 'notes', 'note', 'aadhaar', count(*) FILTER (k = 2), count(*) FILTER (k = 2) FROM n)
  SELECT "table", "column", pattern, "values", CAST(hits AS BIGINT) AS hits FROM c WHERE hits > 0""",
    "dq_pii_screen_notes": "SELECT c_custkey, 'seen, ' || lower(c_mktsegment) AS note FROM customer WHERE c_custkey % 5 = 3",
}
