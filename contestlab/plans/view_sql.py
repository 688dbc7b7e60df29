"""The derived views as DuckDB CTEs over the star-schema tables, for checking the DataFrame forms."""

from __future__ import annotations

from contestlab.functions.metrics import CONFIDENT, WEIGHTS
from contestlab.model import PARTIES, STAR_SQL

A, B, THIRD = (p.lower() for p in PARTIES[:3])


def ratio(num: str, den: str, k: int = 2, unit: int = 1) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN sign({num}) * (CAST(floor((abs({num}) * {2 * unit * 10**k} + ({den})) / (({den}) * 2)) AS DOUBLE) / {float(10**k)}::DOUBLE) END)"


def pct(num: str, den: str, k: int = 2) -> str:
    return ratio(f"CAST({num} AS BIGINT)", f"CAST({den} AS BIGINT)", k, 100)


def rounded(x: str, k: int = 2) -> str:
    return f"(sign({x}) * CAST(floor(abs({x}) * {float(10**k)}::DOUBLE + 0.5::DOUBLE) AS DOUBLE) / {float(10**k)}::DOUBLE)"


def hundredths(x: str) -> str:
    return f"CAST(sign({x}) * floor(abs({x}) * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


def deviation(x: str) -> str:
    h = hundredths(x)
    spread = f"CAST(count({x}) * sum({h}) * 0 + count({x}) * sum({h} * {h}) - sum({h}) * sum({h}) AS DOUBLE)"
    return f"CASE WHEN count({x}) >= 2 THEN {rounded(f'(sqrt({spread} / CAST(count({x}) * (count({x}) - 1) AS DOUBLE)) / 100.0::DOUBLE)')} END"


def mean(x: str, k: int = 2) -> str:
    return ratio(f"CAST(sum({hundredths(x)}) AS BIGINT)", f"count({x}) * 100", k)


def score(inputs: list[str]) -> tuple[str, str]:
    """weight, score."""
    weight = rounded("(0.0::DOUBLE + " + " + ".join(f"CASE WHEN {x} IS NOT NULL THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for x, w in zip(inputs, WEIGHTS, strict=True)) + ")", 4)
    total = "(0.0::DOUBLE + " + " + ".join(f"coalesce({x} * {w}::DOUBLE, 0.0::DOUBLE)" for x, w in zip(inputs, WEIGHTS, strict=True)) + ")"
    return weight, rounded(f"({total} / nullif({weight}, 0))", 4)


GATE = f"((coalesce(lineage_kind NOT IN ('split', 'merge'), true)) AND (coalesce(reviewed, false) OR coalesce(confidence >= {CONFIDENT}::DOUBLE, false)))"
MARGIN = "CASE WHEN contestants >= 2 THEN winner_votes - runner_votes END"
SIGNED = f"CASE WHEN winner_party = party_a THEN {pct(f'({MARGIN})', 'valid_votes')} WHEN winner_party = party_b THEN -{pct(f'({MARGIN})', 'valid_votes')} END"
CELL = "group_id, contest_id, kind, year, unit_id"
POLLED = "(valid_votes + coalesce(rejected, 0))"
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("electors", "valid_votes", "votes_polled", "nota", *(p.lower() for p in PARTIES), "others"))
TURNOUT = f"CASE WHEN booths = booths_with_electors THEN {pct('votes_polled', 'electors')} END"


def _percentile(value: str) -> str:
    return f"(SELECT contest_id, unit_id, CASE WHEN count(*) OVER (PARTITION BY group_id) >= 2 THEN CAST(rank() OVER (PARTITION BY group_id ORDER BY {value}) - 1 AS DOUBLE) / (count(*) OVER (PARTITION BY group_id) - 1) END AS r FROM inputs WHERE {value} IS NOT NULL)"


_WEIGHT, _SCORE = score(["(1 - far.r)", "newv.r", "flt.r", "vol.r"])

VIEWS = f"""
result_candidate AS (SELECT * FROM mv_result_booth_candidate),
result_party AS (SELECT {CELL}, party, CAST(sum(votes) AS BIGINT) AS votes FROM result_candidate GROUP BY {CELL}, party),
totals AS (SELECT {CELL}, CAST(sum(votes) AS BIGINT) AS valid_votes, CAST(sum(votes) FILTER (party = 'NOTA') AS BIGINT) AS nota,
  CAST(sum(votes) FILTER (party IS DISTINCT FROM 'NOTA') AS BIGINT) AS candidate_votes, count(*) FILTER (party IS DISTINCT FROM 'NOTA') AS contestants FROM result_candidate GROUP BY {CELL}),
party_share AS (SELECT p.*, t.valid_votes, {pct("p.votes", "t.valid_votes")} AS share_pct FROM result_party p JOIN totals t USING (contest_id, unit_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY contest_id, unit_id ORDER BY votes DESC, contestant) AS place FROM result_candidate WHERE party IS DISTINCT FROM 'NOTA'),
pivoted AS (SELECT contest_id, unit_id, {", ".join(f"CAST(sum(votes) FILTER (party = '{p}') AS BIGINT) AS {p.lower()}" for p in PARTIES)},
  CAST(sum(votes) FILTER (party NOT IN ({", ".join(f"'{p}'" for p in PARTIES)}, 'NOTA') OR party IS NULL) AS BIGINT) AS others FROM result_party GROUP BY 1, 2),
legs AS (SELECT t.*, u.area_id, u.block_id, u.electors, u.rejected, u.lineage_kind, p.* EXCLUDE (contest_id, unit_id), w.contestant AS winner_party, w.candidate AS winner_candidate, w.votes AS winner_votes,
  r.contestant AS runner_party, r.votes AS runner_votes, c.party_a, c.party_b
  FROM totals t JOIN units u USING (unit_id) LEFT JOIN pivoted p USING (contest_id, unit_id) LEFT JOIN (FROM ranked WHERE place = 1) w USING (contest_id, unit_id)
  LEFT JOIN (FROM ranked WHERE place = 2) r USING (contest_id, unit_id) LEFT JOIN contests c USING (contest_id)),
wide AS (SELECT {CELL}, area_id, block_id, electors, valid_votes, {POLLED} AS votes_polled, rejected, nota, {", ".join(p.lower() for p in PARTIES)}, others,
  winner_party, winner_candidate, winner_votes, runner_party, runner_votes, contestants, {MARGIN} AS margin_votes, {pct(f"({MARGIN})", "valid_votes")} AS margin_pct,
  {SIGNED} AS signed_margin_pct, party_a, party_b, {pct(POLLED, "electors")} AS turnout_pct, lineage_kind FROM legs),
adjacent AS (SELECT group_id, kind, contest_id, year, lag(contest_id) OVER (PARTITION BY group_id, kind ORDER BY year) AS prev_contest_id FROM contests),
quality AS (SELECT contest_id, unit_id, min(confidence) AS confidence, bool_and(reviewed) AS reviewed FROM result_candidate GROUP BY 1, 2),
swing AS (SELECT s.group_id, s.contest_id, s.kind, s.year, s.unit_id, s.party, CASE WHEN b.party IS NOT NULL THEN a.prev_contest_id END AS prev_contest_id, s.share_pct, b.share_pct AS prev_share_pct,
  CASE WHEN {GATE} THEN {rounded("(s.share_pct - b.share_pct)")} END AS swing_pct, CASE WHEN {GATE} THEN s.votes - b.votes END AS swing_votes, confidence, reviewed, lineage_kind
  FROM party_share s JOIN adjacent a USING (contest_id) LEFT JOIN party_share b ON b.contest_id = a.prev_contest_id AND b.unit_id = s.unit_id AND b.party = s.party
  LEFT JOIN quality q ON q.contest_id = s.contest_id AND q.unit_id = s.unit_id LEFT JOIN (SELECT unit_id, lineage_kind FROM units) u ON u.unit_id = s.unit_id WHERE s.party IS DISTINCT FROM 'NOTA'),
swing_vanished AS (SELECT b.group_id, a.contest_id, b.kind, a.year, b.unit_id, b.party, a.prev_contest_id, 0.0::DOUBLE AS share_pct, b.share_pct AS prev_share_pct,
  CASE WHEN {GATE} THEN {rounded("(0.0::DOUBLE - b.share_pct)")} END AS swing_pct, CASE WHEN {GATE} THEN -b.votes END AS swing_votes
  FROM adjacent a JOIN party_share b ON b.contest_id = a.prev_contest_id JOIN quality q ON q.contest_id = a.contest_id AND q.unit_id = b.unit_id JOIN (SELECT unit_id, lineage_kind FROM units) u ON u.unit_id = b.unit_id
  WHERE b.party IS DISTINCT FROM 'NOTA' AND NOT EXISTS (FROM party_share n WHERE n.contest_id = a.contest_id AND n.unit_id = b.unit_id AND n.party IS NOT DISTINCT FROM b.party)),
swing_all AS (SELECT * EXCLUDE (confidence, reviewed, lineage_kind) FROM swing UNION ALL FROM swing_vanished),
transfer AS (SELECT coalesce(l.group_id, v.group_id) AS group_id, coalesce(l.year, v.year) AS year, coalesce(l.unit_id, v.unit_id) AS unit_id, coalesce(l.party, v.party) AS party,
  l.votes AS ls_votes, v.votes AS vs_votes, l.share_pct AS ls_share_pct, v.share_pct AS vs_share_pct, v.votes - l.votes AS delta_votes, {rounded("(v.share_pct - l.share_pct)")} AS delta_share_pct
  FROM (FROM party_share WHERE kind = 'LS') l FULL JOIN (FROM party_share WHERE kind = 'VS') v ON l.unit_id = v.unit_id AND l.year = v.year AND l.party IS NOT DISTINCT FROM v.party),
moved AS (SELECT group_id, year, unit_id, CAST(sum(abs(coalesce({hundredths("vs_share_pct")}, 0) - coalesce({hundredths("ls_share_pct")}, 0))) AS BIGINT) AS moved,
  CAST(max(CAST(ls_votes IS NOT NULL AS BIGINT)) + max(CAST(vs_votes IS NOT NULL AS BIGINT)) AS BIGINT) AS poll_types FROM transfer GROUP BY 1, 2, 3),
floating_vote AS (SELECT group_id, year, unit_id, CASE WHEN poll_types = 2 THEN {rounded("(moved / 100.0::DOUBLE / 2)")} END AS floating_pct, poll_types FROM moved),
volatility AS (SELECT group_id, unit_id, count(signed_margin_pct) AS years_available, {deviation("signed_margin_pct")} AS margin_stddev, {mean("signed_margin_pct")} AS margin_mean FROM wide WHERE kind = 'VS' GROUP BY 1, 2),
windows AS (SELECT group_id, contest_id, kind, year, day AS window_end, lag(day) OVER (PARTITION BY group_id, kind ORDER BY year) AS window_start FROM links),
roll_windows AS (SELECT *, (SELECT max(s.day) FROM snapshots s WHERE s.day <= window_end) AS end_roll, (SELECT max(s.day) FROM snapshots s WHERE s.day <= window_start) AS start_roll FROM windows),
inside AS (SELECT contest_id, unit_id, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions, CAST(sum(modifications) AS BIGINT) AS modifications
  FROM roll_changes JOIN units USING (unit_id) JOIN windows USING (group_id) WHERE day > window_start AND day <= window_end GROUP BY 1, 2),
new_voter_share AS (SELECT u.group_id, w.contest_id, u.unit_id, additions, deletions, modifications, CAST(e.electors AS BIGINT) AS electors, CAST(s.electors AS BIGINT) AS electors_start,
  {pct("additions", "e.electors")} AS new_voter_pct, {pct("(additions - deletions)", "s.electors")} AS net_roll_change_pct
  FROM units u JOIN roll_windows w USING (group_id) LEFT JOIN inside i ON i.contest_id = w.contest_id AND i.unit_id = u.unit_id
  LEFT JOIN snapshots e ON e.unit_id = u.unit_id AND e.day = w.end_roll LEFT JOIN snapshots s ON s.unit_id = u.unit_id AND s.day = w.start_roll),
inputs AS (SELECT w.*, n.new_voter_pct, n.additions, f.floating_pct, v.margin_stddev, v.years_available FROM wide w JOIN contests c ON c.contest_id = w.contest_id AND c.is_baseline
  LEFT JOIN new_voter_share n ON n.contest_id = w.contest_id AND n.unit_id = w.unit_id LEFT JOIN floating_vote f ON f.unit_id = w.unit_id AND f.year = w.year LEFT JOIN volatility v ON v.unit_id = w.unit_id),
scored AS (SELECT i.*, {_WEIGHT} AS weight_used, {_SCORE} AS priority_score,
  array_to_string(list_filter([CASE WHEN far.r IS NOT NULL THEN 'closeness' END, CASE WHEN newv.r IS NOT NULL THEN 'new_voter_pct' END, CASE WHEN flt.r IS NOT NULL THEN 'floating_pct' END, CASE WHEN vol.r IS NOT NULL THEN 'volatility' END], lambda x: x IS NOT NULL), ',') AS inputs_used
  FROM inputs i LEFT JOIN {_percentile("margin_pct")} far USING (contest_id, unit_id) LEFT JOIN {_percentile("new_voter_pct")} newv USING (contest_id, unit_id)
  LEFT JOIN {_percentile("floating_pct")} flt USING (contest_id, unit_id) LEFT JOIN {_percentile("margin_stddev")} vol USING (contest_id, unit_id)),
tiles AS (SELECT contest_id, unit_id, CAST(ntile(4) OVER (PARTITION BY group_id ORDER BY priority_score DESC, unit_id) AS INT) AS priority_quartile FROM scored WHERE priority_score IS NOT NULL),
priority AS (SELECT group_id, unit_id, contest_id, area_id, electors, turnout_pct, margin_pct, margin_votes, signed_margin_pct, winner_party, runner_party, new_voter_pct, additions, floating_pct, margin_stddev, years_available,
  inputs_used, weight_used, priority_score, priority_quartile FROM scored LEFT JOIN tiles USING (contest_id, unit_id)),
area_rollup AS (SELECT *, {TURNOUT} AS turnout_pct, {pct(A, "valid_votes")} AS {A}_pct, {pct(B, "valid_votes")} AS {B}_pct FROM
  (SELECT group_id, contest_id, kind, year, area_id, block_id, count(*) AS booths, {SUMS}, count(electors) AS booths_with_electors FROM wide GROUP BY 1, 2, 3, 4, 5, 6)),
group_candidates AS (SELECT group_id, contest_id, kind, year, candidate, party, contestant, CAST(sum(votes) AS BIGINT) AS votes FROM result_candidate GROUP BY ALL),
heads AS (SELECT contest_id, count(*) AS contestants, {", ".join(f"max({c}) FILTER (place = {k}) AS {w}_{o}" for k, w in ((1, "winner"), (2, "runner")) for c, o in (("contestant", "party"), ("candidate", "candidate"), ("votes", "votes")))}
  FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY votes DESC, candidate) AS place FROM group_candidates WHERE party IS DISTINCT FROM 'NOTA') GROUP BY 1),
rolls AS (SELECT contest_id, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(electors) AS BIGINT) AS roll FROM new_voter_share GROUP BY 1),
whole AS (SELECT group_id, contest_id, kind, year, count(*) AS booths, {SUMS}, count(electors) AS booths_with_electors FROM wide GROUP BY 1, 2, 3, 4),
sure AS (SELECT group_id, count(*) AS units, count(*) FILTER (confidence >= {CONFIDENT}) AS linked FROM units GROUP BY 1),
group_summary AS (SELECT group_id, contest_id, kind, year, is_baseline, booths, electors, valid_votes, votes_polled, nota, winner_party, winner_candidate, winner_votes, runner_party, runner_candidate, runner_votes,
  {MARGIN} AS margin_votes, {pct(f"({MARGIN})", "valid_votes")} AS margin_pct, {SIGNED} AS signed_margin_pct, turnout_pct, {pct(f"coalesce({THIRD}, 0)", "valid_votes")} AS third_share_pct,
  additions, {pct("additions", "roll")} AS new_voter_pct, {pct("linked", "units")} AS link_coverage_pct, units
  FROM (SELECT *, {TURNOUT} AS turnout_pct FROM whole) JOIN (SELECT contest_id, is_baseline, party_a, party_b FROM contests) USING (contest_id) LEFT JOIN heads USING (contest_id) LEFT JOIN rolls USING (contest_id) LEFT JOIN sure USING (group_id)),
joint_segments AS (SELECT year, group_id, contest_id, contestant, segment_votes, CAST(sum(segment_votes) OVER (PARTITION BY year, contestant) AS BIGINT) AS total_votes, count(*) OVER (PARTITION BY year, contestant) AS segments,
  {pct("segment_votes", "sum(segment_votes) OVER (PARTITION BY year, contestant)")} AS segment_pct
  FROM (SELECT year, group_id, contest_id, contestant, CAST(sum(votes) AS BIGINT) AS segment_votes FROM group_candidates WHERE kind = 'LS' GROUP BY ALL))"""


def over_views(select: str) -> str:
    """A SELECT over the views and base tables."""
    return f"WITH {STAR_SQL.strip()},{VIEWS}\n{select}"
