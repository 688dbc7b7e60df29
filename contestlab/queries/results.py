"""Questions about results: headlines, unit and area tables, transfer, priority, comparisons, one unit's card."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestlab.functions import metrics as M
from contestlab.model import BASELINE, PARTIES
from contestlab.plans.view_sql import A, B, THIRD, over_views, pct
from contestlab.plans.views import Views, is_not

from .derived import star_views

METRICS = ("margin_pct", "signed_margin_pct", "turnout_pct", "new_voter_pct", "priority_score", "floating_pct", "margin_stddev", "electors")
OWN = [p.lower() for p in PARTIES]


def where(df: DataFrame, **equal) -> DataFrame:
    """Rows equal in each given column; None means any, a list any of its values."""
    tests = [F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in equal.items() if v is not None]
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def contest(df: DataFrame, label: tuple[str, int] | None) -> DataFrame:
    return where(df, kind=label and label[0], year=label and label[1])


def clamp(limit: int, least: int = 1, most: int = 500) -> int:
    return max(least, min(most, limit))


def summary(v: Views) -> DataFrame:
    """One headline row for each contest, also for those without results."""
    heads = v.group_summary.select("contest_id", "booths", "electors", "valid_votes", "votes_polled", "nota", "winner_party", "winner_candidate", "winner_votes", "runner_party", "runner_candidate", "runner_votes", "margin_votes", "margin_pct")
    rows = v.data.contests.select("group_id", "contest_id", "kind", "year", "is_baseline").join(heads, "contest_id", "left")
    return rows.withColumns({"booths": F.coalesce("booths", F.lit(0)), "turnout_pct": M.turnout_pct(F.col("votes_polled"), F.col("electors"))})


def baseline(v: Views) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in (*OWN[:3], "nota", "electors", "votes_polled")]
    return v.wide.join(v.data.contests.filter("is_baseline").select("contest_id"), "contest_id", "left_semi").groupBy("group_id", "contest_id").agg(*sums)


def data_health(v: Views) -> DataFrame:
    """Counts of what is loaded, one row a group: each table is counted once, and only counts are joined."""
    d, one = v.data, F.count(F.lit(1))
    weak = (F.col("confidence") < M.CONFIDENT) & ~F.col("reviewed")
    units = d.units.groupBy("group_id").agg(one.alias("units"), F.count("electors").alias("units_with_electors"), F.sum(weak.cast("long")).alias("weak_links"))
    loaded = d.votes.groupBy("group_id").agg(F.countDistinct("contest_id").alias("contests_with_results"), one.alias("result_rows"))
    contests = d.contests.groupBy("group_id").agg(one.alias("contests"))
    changes = d.roll_changes.join(d.units.select("unit_id", "group_id"), "unit_id").groupBy("group_id").agg(one.alias("roll_rows"), F.max("day").alias("latest_roll"), F.countDistinct("day").alias("roll_revisions"))
    rows = units.join(contests, "group_id", "left").join(loaded, "group_id", "left").join(changes, "group_id", "left")
    return rows.fillna(0, ["contests", "contests_with_results", "result_rows", "roll_rows", "roll_revisions"])


def units_map(v: Views, metric: str = "margin_pct", group_id: int | None = None, block_id: int | None = None, area_id: int | None = None) -> DataFrame:
    """Every unit with a metric of its baseline contest."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    p = v.priority.select("unit_id", F.col(metric).cast("double").alias("metric"), "winner_party", "runner_party")
    units = where(v.data.units, group_id=group_id, block_id=block_id, area_id=area_id)
    return units.select("group_id", "unit_id", "area_id", "block_id", "confidence", "reviewed").join(p, "unit_id", "left")


def unit_results(v: Views, label: tuple[str, int] | None = None, **scope) -> DataFrame:
    rows = where(contest(v.wide, label), **scope)
    links = v.data.units.select("unit_id", "confidence", "reviewed")
    return rows.select("group_id", "contest_id", "unit_id", "area_id", "block_id", "electors", "votes_polled", "valid_votes", "turnout_pct", *OWN, "others", "nota", "winner_party", "runner_party", "margin_votes", "margin_pct", "signed_margin_pct", "rejected", "lineage_kind").join(links, "unit_id", "left")


def area_results(v: Views, label: tuple[str, int] | None = None, **scope) -> DataFrame:
    return where(contest(v.area_rollup, label), **scope)


def transfer(v: Views, year: int) -> DataFrame:
    units = v.data.units.select("unit_id", "area_id", "block_id")
    f = v.floating_vote.filter(F.col("year") == year).select("unit_id", "floating_pct")
    return v.transfer.filter(F.col("year") == year).join(units, "unit_id").join(f, "unit_id", "left")


def priority(v: Views, limit: int = 200, **scope) -> DataFrame:
    """The units that matter most, those without a score last."""
    rows = where(v.priority.join(v.data.units.select("unit_id", "block_id"), "unit_id"), **scope)
    return rows.orderBy(F.desc_nulls_last("priority_score"), "unit_id").limit(clamp(limit))


def vocab_areas(v: Views) -> DataFrame:
    return v.data.units.groupBy("group_id", "block_id", "area_id").agg(F.count(F.lit(1)).alias("units"))


def vocab_contests(v: Views) -> DataFrame:
    """All contests, with whether any result is loaded, and the pair that the signed margin is oriented by."""
    loaded = v.data.votes.select("contest_id").distinct().withColumn("loaded", F.lit(True))
    return v.data.contests.join(loaded, "contest_id", "left").select("group_id", "contest_id", "kind", "year", "is_baseline", "party_a", "party_b", F.coalesce("loaded", F.lit(False)).alias("has_results"))


def groups(v: Views) -> DataFrame:
    d = v.data
    parts = d.units.groupBy("group_id").agg(F.countDistinct("block_id").alias("blocks"), F.count(F.lit(1)).alias("units"), F.array_join(F.array_sort(F.collect_set("area_id")), " / ").alias("areas"))
    loaded = d.votes.groupBy("group_id").agg(F.countDistinct("contest_id").alias("contests_with_results"))
    heads = v.group_summary.filter("is_baseline").select("group_id", "contest_id", "winner_party", "runner_party", "margin_votes", "margin_pct", "turnout_pct", "electors", "valid_votes", "third_share_pct", "new_voter_pct", "link_coverage_pct")
    return parts.join(loaded, "group_id", "left").join(heads, "group_id", "left")


def group_detail(v: Views, group_id: int) -> DataFrame:
    return v.group_summary.filter(F.col("group_id") == group_id)


def compare(v: Views, kind: str = "VS") -> DataFrame:
    return v.group_summary.filter(F.col("kind") == kind).select("group_id", "contest_id", "year", "is_baseline", "winner_party", "runner_party", "margin_votes", "margin_pct", "signed_margin_pct", "turnout_pct", "electors", "valid_votes", "third_share_pct", "new_voter_pct", "link_coverage_pct", "booths")


def candidates(v: Views, label: tuple[str, int] | None = None) -> DataFrame:
    """Each candidate's votes over a whole contest and their share of all valid votes."""
    rows = contest(v.group_candidates, label)
    whole = rows.groupBy("contest_id").agg(F.sum("votes").alias("valid_votes"))
    rows = rows.join(whole, "contest_id")
    order = Window.partitionBy("contest_id").orderBy(is_not("party", "NOTA").desc(), F.desc("votes"), "candidate")
    place = F.when(is_not("party", "NOTA"), F.row_number().over(order))
    return rows.select("group_id", "contest_id", "candidate", "party", "votes", M.share_pct(F.col("votes"), F.col("valid_votes")).alias("share_pct"), place.alias("place"))


def card(v: Views, unit_ids: Sequence[int] | None = None) -> DataFrame:
    """All about a few units, or each, one row a unit: nested results, rolls and changes, newest first, and caveats."""
    d, pick = v.data, F.lit(True) if unit_ids is None else F.col("unit_id").isin(list(unit_ids))

    def nested(df: DataFrame, name: str, *fields: str, most: int = 50) -> DataFrame:
        rows = F.slice(F.sort_array(F.collect_list(F.struct(*fields)), asc=False), 1, most)
        return df.filter(pick).groupBy("unit_id").agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias(name))

    rows = d.units.filter(pick)
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    parts = [
        nested(v.wide, "results", "year", "kind", "electors", "valid_votes", *OWN, "others", "nota", "winner_party", "runner_party", "margin_votes", "margin_pct", "turnout_pct"),
        nested(d.snapshots.select("unit_id", text("day"), "electors"), "rolls", "day", "electors", most=6),
        nested(d.roll_changes.select("unit_id", text("day"), "additions", "deletions", "modifications"), "changes", "day", "additions", "deletions", "modifications", most=8),
        v.priority.filter(pick).select("unit_id", "priority_score", "priority_quartile", "new_voter_pct", "floating_pct", "margin_stddev"),
    ]
    for part in parts:
        rows = rows.join(part, "unit_id", "left")
    weak = (F.col("confidence") < M.CONFIDENT) & ~F.col("reviewed")
    caveats = F.array_compact(F.array(F.when(weak, "weak link to earlier contests"), F.when(F.col("lineage_kind").isNotNull(), F.concat(F.lit("lineage: "), "lineage_kind")), F.when(F.col("results").isNull(), "no results loaded")))
    return rows.withColumn("caveats", F.array_join(caveats, "; "))


CARD = (
    "unit_id bigint, group_id int, area_id int, block_id int, electors bigint, rejected bigint, confidence double, reviewed boolean, lineage_kind string, results string, rolls string, changes string, "
    "priority_score double, priority_quartile int, new_voter_pct double, floating_pct double, margin_stddev double, caveats string"
)


def store_cards(v: Views, path: str) -> None:
    """All cards written in the order of their units, so that one is read from one place."""
    card(v).repartitionByRange("unit_id").sortWithinPartitions("unit_id").write.mode("overwrite").parquet(path)


def stored_card(spark: SparkSession, path: str, unit_ids: Sequence[int]) -> DataFrame:
    return spark.read.schema(CARD).parquet(path).filter(F.col("unit_id").isin(list(unit_ids)))


def scenario_baseline(v: Views, label: tuple[str, int] = BASELINE) -> DataFrame:
    """Party votes of each unit with its additions for the same contest: one row a unit and party."""
    news = v.new_voter_share.select("contest_id", "unit_id", "additions")
    return contest(v.result_party, label).join(news, ["contest_id", "unit_id"], "left").select("group_id", "contest_id", "unit_id", "party", "votes", F.coalesce("additions", F.lit(0)).alias("additions"))


def lead(v: Views, label: tuple[str, int], of: str, over: str, limit: int = 20) -> DataFrame:
    """The units where one party leads another by most."""
    rows = contest(v.wide, label).select("unit_id", "area_id", of, over, (F.col(of) - F.col(over)).alias("lead"), "turnout_pct")
    return rows.orderBy(F.desc_nulls_last("lead"), "unit_id").limit(clamp(limit))


def worst_swing(v: Views, label: tuple[str, int], party: str, limit: int = 20) -> DataFrame:
    rows = contest(v.swing, label).filter((F.col("party") == party) & F.col("swing_pct").isNotNull())
    return rows.select("unit_id", "prev_share_pct", "share_pct", "swing_pct").join(v.data.units.select("unit_id", "area_id"), "unit_id").orderBy("swing_pct", "unit_id").limit(clamp(limit))


def split_ticket(v: Views, year: int, ls: str, vs: str) -> DataFrame:
    """Areas by units that one party won in one poll of a year and another party in the other."""
    rows = v.transfer.filter(F.col("year") == year)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("n"), "party")))["party"]
    won = rows.groupBy("unit_id").agg(first("ls_votes").alias("ls"), first("vs_votes").alias("vs")).filter((F.col("ls") == ls) & (F.col("vs") == vs))
    return won.join(v.data.units.select("unit_id", "area_id"), "unit_id").groupBy("area_id").agg(F.count(F.lit(1)).alias("units"))


def new_voters_by_area(v: Views, label: tuple[str, int] = BASELINE) -> DataFrame:
    now = contest(v.data.contests, label).select("contest_id")
    rows = v.new_voter_share.join(now, "contest_id").join(v.data.units.select("unit_id", "area_id"), "unit_id")
    rows = rows.groupBy("area_id").agg(*(F.sum(c).alias(c) for c in ("additions", "deletions", "electors")))
    return rows.withColumn("new_voter_pct", M.new_voter_pct(F.col("additions"), F.col("electors")))


def areas_by_additions(v: Views, limit: int = 20) -> DataFrame:
    rows = v.data.roll_changes.join(v.data.units.select("unit_id", "area_id"), "unit_id").groupBy("area_id").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    return rows.orderBy(F.desc("additions"), "area_id").limit(clamp(limit))


def largest_moves(v: Views, year: int, limit: int = 10) -> DataFrame:
    """Units and parties with the largest absolute transfer."""
    rows = v.transfer.filter((F.col("year") == year) & F.col("delta_share_pct").isNotNull())
    return rows.select("unit_id", "party", "delta_share_pct", F.abs("delta_share_pct").alias("size")).orderBy(F.desc("size"), "unit_id", "party").limit(clamp(limit))


def alliance_swing(v: Views, alliances: DataFrame) -> DataFrame:
    """Swing of alliances (contest_id, party, alliance): each contest by its own membership, gated like party swing."""
    shares = v.party_share.join(alliances, ["contest_id", "party"]).groupBy("group_id", "contest_id", "unit_id", "alliance").agg(F.sum(M.hundredths(F.col("share_pct"))).alias("h"))
    before = shares.select(F.col("contest_id").alias("prev_contest_id"), "unit_id", "alliance", F.col("h").alias("prev_h"))
    rows = shares.join(v.adjacent.select("contest_id", "prev_contest_id"), "contest_id").join(before, ["prev_contest_id", "unit_id", "alliance"])
    rows = rows.join(v.quality, ["contest_id", "unit_id"], "left").join(v.data.units.select("unit_id", "lineage_kind"), "unit_id", "left")
    allowed = M.comparison_allowed(F.col("confidence"), F.col("reviewed"), F.col("lineage_kind"), F.lit(False))
    return rows.select("group_id", "contest_id", "unit_id", "alliance", (F.col("h") / 100.0).alias("share_pct"), (F.col("prev_h") / 100.0).alias("prev_share_pct"), F.when(allowed, (F.col("h") - F.col("prev_h")) / 100.0).alias("swing_pct"))


def star_alliances(v: Views) -> DataFrame:
    """Membership that changes over time, for the star data."""
    even = F.col("year") % 2 == 0
    party = F.explode(F.array(*map(F.lit, PARTIES))).alias("party")
    rows = v.data.contests.select("contest_id", "year", party)
    front = F.col("party").isin(*PARTIES[:2]) | (even & (F.col("party") == PARTIES[2]))
    return rows.select("contest_id", "party", F.when(front, "front").otherwise("rest").alias("alliance"))


def _star(f, *args, **kw):
    def query(spark, sf_dir):
        views = star_views(spark, sf_dir)
        return views.held_by(f(views, *args, **kw))

    return query


YEAR = BASELINE[1]
#: Units that have all there is on a card.
CARD_UNITS = tuple(range(1, 40))
QUERIES = {
    "q_summary": _star(summary),
    "q_baseline": _star(baseline),
    "q_data_health": _star(data_health),
    "q_booths_map": _star(units_map),
    "q_results_booths": _star(unit_results, BASELINE),
    "q_results_areas": _star(area_results, BASELINE),
    "q_transfer": _star(transfer, YEAR),
    "q_priority": _star(priority),
    "q_vocab_areas": _star(vocab_areas),
    "q_vocab": _star(vocab_contests),
    "q_acs": _star(groups),
    "q_ac_detail": _star(group_detail, 1),
    "q_compare": _star(compare),
    "q_candidates": _star(candidates),
    "q_card": _star(card, CARD_UNITS),
    "q_scenario_baseline": _star(scenario_baseline),
    "crib_1": _star(lead, BASELINE, B, A),
    "crib_2": _star(worst_swing, BASELINE, PARTIES[0]),
    "crib_3": _star(split_ticket, YEAR, PARTIES[1], PARTIES[0]),
    "crib_4": _star(new_voters_by_area),
    "crib_5": _star(priority, 30),
    "agg_area_topk": _star(areas_by_additions),
    "topk_abs": _star(largest_moves, YEAR),
    "alliance_swing_pct": lambda spark, sf_dir: (lambda v: alliance_swing(v, star_alliances(v)))(star_views(spark, sf_dir)),
    "filt_scope": lambda spark, sf_dir: (lambda v: Views(v.data.scope(group_id=1, block_id=101)).wide)(star_views(spark, sf_dir)),
}

_NOW = f"kind = '{BASELINE[0]}' AND year = {YEAR}"
_OWN = ", ".join(OWN)
_PRIORITY = "SELECT p.*, u.block_id FROM priority p JOIN units u USING (unit_id) ORDER BY priority_score DESC NULLS LAST, unit_id LIMIT "

def _card_sql() -> str:
    """Cards as JSON texts: lists of rows, newest first."""
    nested = lambda table, name, fields, order, most: f"{name} AS (SELECT unit_id, CAST(to_json(list({{{', '.join(f"'{f}': {e}" for f, e in fields.items())}}} ORDER BY {order})[1:{most}]) AS VARCHAR) AS {name} FROM {table} GROUP BY 1)"
    plain = lambda *names: {n: n for n in names}
    day = {"day": "strftime(day, '%Y-%m-%d')"}
    return f"""WITH {nested("wide", "results", plain("year", "kind", "electors", "valid_votes", *OWN, "others", "nota", "winner_party", "runner_party", "margin_votes", "margin_pct", "turnout_pct"), "year DESC, kind DESC", 50)},
  {nested("snapshots", "rolls", day | plain("electors"), "day DESC", 6)}, {nested("roll_changes", "changes", day | plain("additions", "deletions", "modifications"), "day DESC", 8)}
  SELECT u.*, results, rolls, changes, priority_score, priority_quartile, new_voter_pct, floating_pct, margin_stddev,
    array_to_string(list_filter([CASE WHEN confidence < {M.CONFIDENT}::DOUBLE AND NOT reviewed THEN 'weak link to earlier contests' END, 'lineage: ' || lineage_kind, CASE WHEN results IS NULL THEN 'no results loaded' END], lambda x: x IS NOT NULL), '; ') AS caveats
  FROM units u LEFT JOIN results USING (unit_id) LEFT JOIN rolls USING (unit_id) LEFT JOIN changes USING (unit_id) LEFT JOIN (SELECT unit_id, priority_score, priority_quartile, new_voter_pct, floating_pct, margin_stddev FROM priority) USING (unit_id) WHERE unit_id IN {CARD_UNITS}"""


SQL = {
    name: over_views(sql)
    for name, sql in {
        "q_card": f"SELECT * FROM ({_card_sql()})",
        "q_summary": f"""SELECT c.group_id, c.contest_id, c.kind, c.year, c.is_baseline, coalesce(s.booths, 0) AS booths, s.electors, s.valid_votes, s.votes_polled, s.nota, s.winner_party, s.winner_candidate, s.winner_votes,
  s.runner_party, s.runner_candidate, s.runner_votes, s.margin_votes, s.margin_pct, {pct("s.votes_polled", "s.electors")} AS turnout_pct FROM contests c LEFT JOIN group_summary s USING (contest_id)""",
        "q_baseline": f"SELECT group_id, contest_id, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in (*OWN[:3], 'nota', 'electors', 'votes_polled'))} FROM wide WHERE {_NOW} GROUP BY 1, 2",
        "q_data_health": """SELECT g.group_id, (SELECT count(*) FROM units u WHERE u.group_id = g.group_id) AS units, (SELECT count(electors) FROM units u WHERE u.group_id = g.group_id) AS units_with_electors,
  (SELECT count(*) FROM units u WHERE u.group_id = g.group_id AND confidence < 0.85 AND NOT reviewed) AS weak_links, (SELECT count(*) FROM contests c WHERE c.group_id = g.group_id) AS contests,
  (SELECT count(DISTINCT contest_id) FROM result_candidate r WHERE r.group_id = g.group_id) AS contests_with_results, (SELECT count(*) FROM result_candidate r WHERE r.group_id = g.group_id) AS result_rows,
  (SELECT count(*) FROM roll_changes JOIN units u USING (unit_id) WHERE u.group_id = g.group_id) AS roll_rows, (SELECT max(day) FROM roll_changes JOIN units u USING (unit_id) WHERE u.group_id = g.group_id) AS latest_roll,
  (SELECT count(DISTINCT day) FROM roll_changes JOIN units u USING (unit_id) WHERE u.group_id = g.group_id) AS roll_revisions FROM (SELECT DISTINCT group_id FROM units) g""",
        "q_booths_map": "SELECT u.group_id, u.unit_id, u.area_id, u.block_id, u.confidence, u.reviewed, CAST(p.margin_pct AS DOUBLE) AS metric, p.winner_party, p.runner_party FROM units u LEFT JOIN priority p USING (unit_id)",
        "q_results_booths": f"""SELECT w.group_id, w.contest_id, w.unit_id, w.area_id, w.block_id, w.electors, votes_polled, valid_votes, turnout_pct, {_OWN}, others, nota, winner_party, runner_party, margin_votes, margin_pct, signed_margin_pct,
  w.rejected, w.lineage_kind, u.confidence, u.reviewed FROM wide w LEFT JOIN units u USING (unit_id) WHERE {_NOW}""",
        "q_results_areas": f"SELECT * FROM area_rollup WHERE {_NOW}",
        "q_transfer": f"SELECT t.*, u.area_id, u.block_id, f.floating_pct FROM transfer t JOIN units u USING (unit_id) LEFT JOIN floating_vote f ON f.unit_id = t.unit_id AND f.year = t.year WHERE t.year = {YEAR}",
        "q_priority": _PRIORITY + "200",
        "q_vocab_areas": "SELECT group_id, block_id, area_id, count(*) AS units FROM units GROUP BY 1, 2, 3",
        "q_vocab": "SELECT group_id, contest_id, kind, year, is_baseline, party_a, party_b, EXISTS (SELECT 1 FROM result_candidate r WHERE r.contest_id = c.contest_id) AS has_results FROM contests c",
        "q_acs": """SELECT u.group_id, u.blocks, u.units, u.areas, l.n AS contests_with_results, s.contest_id, s.winner_party, s.runner_party, s.margin_votes, s.margin_pct, s.turnout_pct, s.electors, s.valid_votes, s.third_share_pct,
  s.new_voter_pct, s.link_coverage_pct FROM (SELECT group_id, count(DISTINCT block_id) AS blocks, count(*) AS units, array_to_string(list_sort(list_distinct(list(area_id))), ' / ') AS areas FROM units GROUP BY 1) u
  LEFT JOIN (SELECT group_id, count(DISTINCT contest_id) AS n FROM result_candidate GROUP BY 1) l USING (group_id) LEFT JOIN (FROM group_summary WHERE is_baseline) s USING (group_id)""",
        "q_ac_detail": "SELECT * FROM group_summary WHERE group_id = 1",
        "q_compare": """SELECT group_id, contest_id, year, is_baseline, winner_party, runner_party, margin_votes, margin_pct, signed_margin_pct, turnout_pct, electors, valid_votes, third_share_pct, new_voter_pct, link_coverage_pct, booths
  FROM group_summary WHERE kind = 'VS'""",
        "q_candidates": f"""SELECT group_id, contest_id, candidate, party, votes, {pct("votes", "sum(votes) OVER (PARTITION BY contest_id)")} AS share_pct,
  CASE WHEN party != 'NOTA' THEN CAST(row_number() OVER (PARTITION BY contest_id ORDER BY party != 'NOTA' DESC, votes DESC, candidate) AS INT) END AS place FROM group_candidates""",
        "q_scenario_baseline": f"SELECT p.group_id, p.contest_id, p.unit_id, p.party, p.votes, coalesce(n.additions, 0) AS additions FROM result_party p LEFT JOIN new_voter_share n USING (contest_id, unit_id) WHERE {_NOW}",
        "crib_1": f"SELECT unit_id, area_id, {B}, {A}, {B} - {A} AS lead, turnout_pct FROM wide WHERE {_NOW} ORDER BY lead DESC NULLS LAST, unit_id LIMIT 20",
        "crib_2": f"SELECT s.unit_id, u.area_id, s.prev_share_pct, s.share_pct, s.swing_pct FROM swing s JOIN units u USING (unit_id) WHERE {_NOW} AND party = '{PARTIES[0]}' AND swing_pct IS NOT NULL ORDER BY swing_pct, unit_id LIMIT 20",
        "crib_3": f"""SELECT area_id, count(*) AS units FROM (SELECT DISTINCT ON (unit_id) unit_id, party FROM transfer WHERE year = {YEAR} AND ls_votes IS NOT NULL ORDER BY unit_id, ls_votes DESC, party) l
  JOIN (SELECT DISTINCT ON (unit_id) unit_id, party FROM transfer WHERE year = {YEAR} AND vs_votes IS NOT NULL ORDER BY unit_id, vs_votes DESC, party) v USING (unit_id) JOIN units USING (unit_id)
  WHERE l.party = '{PARTIES[1]}' AND v.party = '{PARTIES[0]}' GROUP BY 1""",
        "crib_4": f"""SELECT area_id, additions, deletions, electors, {pct("additions", "electors")} AS new_voter_pct FROM (SELECT u.area_id, CAST(sum(n.additions) AS BIGINT) AS additions, CAST(sum(n.deletions) AS BIGINT) AS deletions, CAST(sum(n.electors) AS BIGINT) AS electors
  FROM new_voter_share n JOIN units u USING (unit_id) JOIN contests c USING (contest_id) WHERE {_NOW} GROUP BY 1)""",
        "crib_5": _PRIORITY + "30",
        "agg_area_topk": "SELECT area_id, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions FROM roll_changes JOIN units USING (unit_id) GROUP BY 1 ORDER BY additions DESC, area_id LIMIT 20",
        "topk_abs": f"SELECT unit_id, party, delta_share_pct, abs(delta_share_pct) AS size FROM transfer WHERE year = {YEAR} AND delta_share_pct IS NOT NULL ORDER BY size DESC, unit_id, party LIMIT 10",
        "alliance_swing_pct": f"""SELECT n.group_id, n.contest_id, n.unit_id, n.alliance, n.h / 100.0::DOUBLE AS share_pct, b.h / 100.0::DOUBLE AS prev_share_pct,
  CASE WHEN coalesce(lineage_kind NOT IN ('split', 'merge'), true) AND (q.reviewed OR q.confidence >= 0.85) THEN (n.h - b.h) / 100.0::DOUBLE END AS swing_pct
  FROM (SELECT p.group_id, p.contest_id, p.unit_id, CASE WHEN party IN ('{PARTIES[0]}', '{PARTIES[1]}') OR (year % 2 = 0 AND party = '{PARTIES[2]}') THEN 'front' ELSE 'rest' END AS alliance, CAST(sum(round(share_pct * 100)) AS BIGINT) AS h
    FROM party_share p WHERE party IN ({", ".join(f"'{p}'" for p in PARTIES)}) GROUP BY 1, 2, 3, 4) n JOIN adjacent a USING (contest_id)
  JOIN (SELECT p.contest_id, p.unit_id, CASE WHEN party IN ('{PARTIES[0]}', '{PARTIES[1]}') OR (year % 2 = 0 AND party = '{PARTIES[2]}') THEN 'front' ELSE 'rest' END AS alliance, CAST(sum(round(share_pct * 100)) AS BIGINT) AS h
    FROM party_share p WHERE party IN ({", ".join(f"'{p}'" for p in PARTIES)}) GROUP BY 1, 2, 3) b ON b.contest_id = a.prev_contest_id AND b.unit_id = n.unit_id AND b.alliance = n.alliance
  JOIN quality q ON q.contest_id = n.contest_id AND q.unit_id = n.unit_id JOIN units u ON u.unit_id = n.unit_id""",
        "filt_scope": "SELECT * FROM wide WHERE group_id = 1 AND block_id = 101",
    }.items()
}
