"""Matching, blending, scenarios, near-duplicates and vector search over the star-schema data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlab.functions import metrics as M
from contestlab.functions import text as T
from contestlab.model import BASELINE, PAIR, PARTIES
from contestlab.operators import blend as B
from contestlab.operators import dedupe as D
from contestlab.operators import match as X
from contestlab.operators import scenario as S
from contestlab.plans.view_sql import over_views
from contestlab.sources.stored import StoredTable

from .derived import star_views
from .results import scenario_baseline
from .texts import KINDS, SIMHASH_SQL, read

YEAR = 2005
COMMUNITIES = (("AUTOMOBILE", "GEN", False), ("BUILDING", "SC", False), ("FURNITURE", "ST", False), ("HOUSEHOLD", "OBC", False), ("MACHINERY", "SC", True))


def stations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Odd parts as the older list and even ones as anchors; the brand is the group."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_size") % len(KINDS) + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("group_id"), F.col("p_partkey").alias("station"), F.concat(kind, F.lit(" "), "p_name").alias("building"), F.col("p_type").alias("place"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("part"))
    return rows.filter("station % 2 = 1"), rows.filter("station % 2 = 0")


def xwalk_score(spark, sf_dir):
    return X.score_stations(*stations(spark, sf_dir)).select("group_id", "station", "anchor", "score", "capped")


def xwalk_match(spark, sf_dir):
    return X.match_stations(*stations(spark, sf_dir))


def _relations(spark, sf_dir):
    old, anchors = (D.written(X.keyed(x), "keyed") for x in stations(spark, sf_dir))
    forward = D.written(X.match_keyed(old, anchors), "forward")
    return forward, X.lineage(forward, D.written(X.match_keyed(anchors, old), "backward")), anchors


def xwalk_lineage(spark, sf_dir):
    return _relations(spark, sf_dir)[1]


def _applied(part: str):
    def query(spark, sf_dir):
        forward, relations, anchors = _relations(spark, sf_dir)
        units = anchors.select("group_id", "station", X.unit_uid(F.col("group_id"), F.col("station")).alias("unit_uid"))
        return X.apply_matches(forward, relations, units)[part]

    return query


def histogram(spark, sf_dir):
    """Surnames of orders by nation: the priority stands for the name."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("unit_id"))
    o = read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("unit_id", F.col("o_orderpriority").alias("surname")).agg(F.count(F.lit(1)).alias("n"))


def dictionary(spark: SparkSession) -> DataFrame:
    rows = [("1-URGENT", "AUTOMOBILE", 1.0), ("2-HIGH", "BUILDING", 0.75), ("2-HIGH", "HOUSEHOLD", 0.25), ("3-MEDIUM", "FURNITURE", 1.0), ("4-NOT SPECIFIED", "HOUSEHOLD", 0.5)]
    return spark.createDataFrame(rows, "surname string, community string, weight double")


def community_estimates(spark, sf_dir):
    h, d = histogram(spark, sf_dir), dictionary(spark)
    n = F.col("n_nationkey")
    units = read(spark, sf_dir, "nation").select(n.alias("unit_id"), F.when(n % 4 != 0, 10.0 + n % 7).alias("census_sc"), F.when(n % 5 != 0, 5.0 + n % 3).alias("census_st"), F.when(n % 4 != 0, 2001).alias("census_year"))
    electors = h.groupBy("unit_id").agg(F.sum("n").alias("electors"))
    units = units.join(electors, "unit_id", "left").join(B.token_quality(h, d), "unit_id", "left")
    communities = spark.createDataFrame(COMMUNITIES, "community string, category string, is_other boolean")
    survey = read(spark, sf_dir, "customer").filter("c_nationkey % 6 = 0").groupBy(F.col("c_nationkey").alias("unit_id"), F.col("c_mktsegment").alias("community")).agg(F.count(F.lit(1)).alias("n"))
    return B.blend(units, B.surname_counts(h, d), communities, survey, YEAR)


def blend_booth(spark, sf_dir):
    return community_estimates(spark, sf_dir).select("unit_id", "community", F.round("est_pct", 6).alias("est_pct"), F.col("est_count").cast("long").alias("est_count"), "confidence")


def _shares(spark, sf_dir):
    """Each area's estimates with the first two parties' shares in the baseline contests."""
    a, b = (p.lower() for p in PARTIES[:2])
    areas = star_views(spark, sf_dir).area_rollup.filter((F.col("kind") == BASELINE[0]) & (F.col("year") == BASELINE[1]))
    areas = areas.select(F.col("area_id").alias("unit_id"), F.col(f"{a}_pct").alias("share_a"), F.col(f"{b}_pct").alias("share_b"))
    return community_estimates(spark, sf_dir).filter("confidence >= 0.4").join(areas, "unit_id", "left")


def community_shares(spark, sf_dir):
    return _shares(spark, sf_dir).select("unit_id", "community", F.round("est_pct", 6).alias("est_pct"), "confidence", "share_a", "share_b")


def stored_dictionary(spark, sf_dir) -> StoredTable:
    """The words of parts' names with the types that go with them, by their share of the word's parts: a dictionary that is kept and merged into."""
    words = read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("surname"), F.col("p_type").alias("community"))
    each = words.groupBy("surname", "community").agg(F.count(F.lit(1)).alias("n"))
    whole = words.groupBy("surname").agg(F.count(F.lit(1)).alias("all"))
    rows = each.join(whole, "surname").select("surname", "community", (F.floor(F.col("n") * 10_000 / F.col("all")) / 10_000.0).alias("weight"))
    table = StoredTable.create(rows.filter("community != 'PROMO'"), f"{D.shared_dir(spark)}/dictionary-{uuid.uuid4().hex}", ["surname", "community"], buckets=8)
    # an editor's changes: one community comes in, and of another all weights are halved
    table.upsert(rows.filter("community = 'PROMO'"))
    table.upsert(rows.filter("community = 'LARGE'").withColumn("weight", F.col("weight") / 2))
    return table


def surnames(spark, sf_dir, text: str = "o"):
    """The dictionary's names that hold a text, with their community: a page of an editor, 500 rows at most."""
    kinds = read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("community")).agg(F.max("p_size").alias("category"))
    found = stored_dictionary(spark, sf_dir).read().join(kinds, "community").filter(F.col("surname").ilike(f"%{text}%"))
    return found.select("surname", "community", "category", "weight").orderBy("surname", "community").limit(500)


def associations(spark, sf_dir, least: int = 4):
    """Ecological correlation and line of community share and vote share; nothing about anyone's vote. least: 30 for real units; here areas are few."""
    x, a, b = F.col("est_pct"), F.col("share_a"), F.col("share_b")
    rows = _shares(spark, sf_dir).filter("share_a is not null").groupBy("community").agg(F.count(F.lit(1)).alias("units"), M.correlation(x, a, least).alias("r_a"), M.correlation(x, b, least).alias("r_b"), F.when(F.count(x) >= least, F.regr_slope(a, x)).alias("slope"), F.when(F.count(x) >= least, F.regr_intercept(a, x)).alias("intercept"))
    return rows.filter(F.col("units") >= least).select("community", "units", *(F.round(c, 6).alias(c) for c in ("r_a", "r_b", "slope", "intercept")))


def strongest_associations(spark, sf_dir):
    """Communities by the strength of their association with the first party."""
    rows = associations(spark, sf_dir).select("community", F.round("r_a", 3).alias("r_a"), F.round("r_b", 3).alias("r_b"), "units")
    return rows.orderBy(F.desc(F.abs(F.coalesce("r_a", F.lit(0.0)))), "community")


SHIFT = S.Scenario(contest=PAIR, transfer=S.one_way(PARTIES[2], PARTIES[1], 0.6, PARTIES[0]), alliance={PARTIES[1]: "rest", PARTIES[3]: "rest"}, turnout=0.95, sympathy=0.1, draws=500)


def _scenario(f, **change):
    def query(spark, sf_dir):
        return f(scenario_baseline(star_views(spark, sf_dir)), S.Scenario(**{**SHIFT.__dict__, **change}))

    return query


def scen_project(spark, sf_dir):
    return _scenario(S.project)(spark, sf_dir).select("party", F.round("votes", 4).alias("votes"), "place")


def largest_remainder(spark, sf_dir):
    """1000 seats of each region dealt to its nations by their customers."""
    rows = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region")), "nation").withColumn("total", F.lit(1000).cast("long"))
    return S.allocate(rows, "region", "total", "n", "nation").select("region", "nation", "seats")


def dedupe_near(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.simhash(T.fold(F.col("text"))).alias("simhash"))
    return D.first_seen(D.written(rows, "hashes"))


def vec_search(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return D.vector_search(rows.select("vec_id", "embedding"), rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "place")


QUERIES = {
    "xwalk_score": xwalk_score,
    "xwalk_match": xwalk_match,
    "xwalk_splits": xwalk_lineage,
    "xwalk_apply": _applied("links"),
    "uid_mint": _applied("new_units"),
    "xwalk_review": _applied("review_queue"),
    "blend_surname": lambda spark, sf_dir: B.surname_estimates(histogram(spark, sf_dir), dictionary(spark)),
    "blend_booth": blend_booth,
    "q_community": community_shares,
    "q_community_correlation": associations,
    "q_surnames": surnames,
    "crib_6": strongest_associations,
    "scen_project": scen_project,
    "scen_monte_carlo": _scenario(S.band),
    "topk_variance": _scenario(S.most_variable),
    "math_largest_remainder": largest_remainder,
    "dedupe_near": dedupe_near,
    "vec_search": vec_search,
}

_KIND = "['PRIMARY_SCHOOL', 'HIGH_SCHOOL', 'COMMUNITY_HALL', 'HEALTH_CENTRE', 'PANCHAYAT_BHAWAN'][p_size % 5 + 1]"
_WEIGHTS = "0.5::DOUBLE + CASE WHEN part IS NOT NULL THEN 0.3::DOUBLE + 0.2::DOUBLE ELSE 0.3::DOUBLE END"
_PAIRS = f"""s AS (SELECT p_brand AS group_id, p_partkey AS station, {_KIND} AS kind, lower({_KIND} || ' ' || p_name) AS building, lower(p_type) AS place, CASE WHEN p_partkey % 5 != 0 THEN p_size END AS part FROM part),
raw AS (SELECT a.group_id, a.station, b.station AS anchor, a.kind != b.kind AS capped, 0.0::DOUBLE + jaro_winkler_similarity(a.building, b.building) * 0.5::DOUBLE + jaro_winkler_similarity(a.place, b.place) * 0.3::DOUBLE
  + coalesce(CAST(CAST(a.part = b.part AS INT) AS DOUBLE) * 0.2::DOUBLE, 0.0::DOUBLE) AS total, 0.0::DOUBLE + 0.5::DOUBLE + 0.3::DOUBLE + CASE WHEN a.part IS NOT NULL AND b.part IS NOT NULL THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS weight
  FROM s a JOIN s b ON a.group_id = b.group_id AND a.station % 2 != b.station % 2),
pairs AS (SELECT group_id, station, anchor, capped, floor((CASE WHEN capped THEN least(total / weight, 0.6::DOUBLE) ELSE total / weight END) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS score FROM raw),
best AS (SELECT *, row_number() OVER (PARTITION BY group_id, station ORDER BY score DESC, anchor) AS place FROM pairs),
both_ways AS (SELECT s.group_id, s.station, coalesce(a.score, 0) AS score, r.anchor AS runner_up, r.score AS runner_score, CASE WHEN coalesce(a.score, 0) >= 0.995 THEN 'exact' WHEN a.score >= 0.85 THEN 'fuzzy' WHEN a.score >= 0.65 THEN 'review' ELSE 'new' END AS method,
  CASE WHEN a.score >= 0.65 THEN a.anchor END AS anchor FROM s LEFT JOIN (FROM best WHERE place = 1) a USING (group_id, station) LEFT JOIN (FROM best WHERE place = 2) r USING (group_id, station)),
forward AS (FROM both_ways WHERE station % 2 = 1),
near AS (SELECT *, count(*) OVER (PARTITION BY group_id, anchor) AS n FROM both_ways WHERE anchor IS NOT NULL AND score >= 0.75),
lineage AS (SELECT group_id, station, anchor, 'merge' AS kind, 1.0::DOUBLE AS weight FROM near WHERE n > 1 AND station % 2 = 1
  UNION ALL SELECT group_id, anchor, station, 'split', floor(1.0::DOUBLE / n * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE FROM near WHERE n > 1 AND station % 2 = 0),
minted AS (SELECT f.group_id, f.station, f.group_id || '-B' || repeat('0', 4 - len(CAST(m + i AS VARCHAR))) || CAST(m + i AS VARCHAR) AS unit_uid
  FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY station) AS i FROM forward WHERE method = 'new') f LEFT JOIN (SELECT group_id, max(station) AS m FROM s WHERE station % 2 = 0 GROUP BY 1) USING (group_id)),
applied AS (SELECT f.*, coalesce(CASE WHEN f.anchor IS NOT NULL THEN f.group_id || '-B' || repeat('0', 4 - len(CAST(f.anchor AS VARCHAR))) || CAST(f.anchor AS VARCHAR) END, m.unit_uid) AS unit_uid, EXISTS (FROM lineage l WHERE l.group_id = f.group_id AND l.anchor = f.anchor) AS related
  FROM forward f LEFT JOIN minted m USING (group_id, station))"""
_HIST = """h AS (SELECT c_nationkey AS unit_id, o_orderpriority AS surname, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
d(surname, community, weight) AS (VALUES ('1-URGENT', 'AUTOMOBILE', 1.0::DOUBLE), ('2-HIGH', 'BUILDING', 0.75::DOUBLE), ('2-HIGH', 'HOUSEHOLD', 0.25::DOUBLE), ('3-MEDIUM', 'FURNITURE', 1.0::DOUBLE), ('4-NOT SPECIFIED', 'HOUSEHOLD', 0.5::DOUBLE)),
counts AS (SELECT unit_id, community, sum(n * weight) AS n FROM h JOIN d USING (surname) GROUP BY 1, 2),
quality AS (SELECT unit_id, CAST(sum(n) AS BIGINT) AS matched, sum(n * sure) AS confident FROM h JOIN (SELECT surname, sum(CASE WHEN weight >= 0.8 THEN weight ELSE 0.0::DOUBLE END) AS sure FROM d GROUP BY 1) USING (surname) GROUP BY 1)"""


def _blended() -> str:
    """The blend as CTEs after _HIST."""
    steps, at = [], "b1"
    for cat, census in (("SC", "census_sc"), ("ST", "census_st")):
        mine, to = f"coalesce(category = '{cat}', false)", f"b_{cat}"
        steps.append(f"""{to}_x AS (SELECT *, coalesce(sum(CASE WHEN {mine} THEN pct END) OVER w, 0) AS now, sum(pct) OVER w AS whole, 0.7::DOUBLE * own_{cat} + 0.3::DOUBLE * {census} AS goal, max(CAST({mine} AND is_other AS INT)) OVER w AS has_other FROM {at} WINDOW w AS (PARTITION BY unit_id)),
{to} AS (SELECT * EXCLUDE (now, whole, goal, has_other) REPLACE (CASE WHEN goal IS NULL OR NOT (now > 0 OR (goal > 0 AND has_other = 1)) THEN pct WHEN {mine} AND now > 0 THEN pct * goal / now WHEN {mine} AND is_other THEN goal WHEN {mine} THEN pct
  WHEN whole - now > 0 THEN pct * greatest(greatest(whole, goal) - goal, 0) / (whole - now) ELSE pct END AS pct) FROM {to}_x)""")
        at = to
    known = ", ".join(f"('{c}', '{k}', {str(o).lower()})" for c, k, o in COMMUNITIES)
    return f"""u AS (SELECT n_nationkey AS unit_id, e.electors, q.matched, q.confident, CASE WHEN n_nationkey % 4 != 0 THEN 10.0::DOUBLE + n_nationkey % 7 END AS census_sc, CASE WHEN n_nationkey % 5 != 0 THEN 5.0::DOUBLE + n_nationkey % 3 END AS census_st,
  CASE WHEN n_nationkey % 4 != 0 THEN 0.8::DOUBLE ELSE 0 END AS fresh FROM nation LEFT JOIN (SELECT unit_id, CAST(sum(n) AS BIGINT) AS electors FROM h GROUP BY 1) e ON n_nationkey = e.unit_id LEFT JOIN quality q ON n_nationkey = q.unit_id),
known(community, category, is_other) AS (VALUES {known}),
s0 AS (SELECT unit_id, community, n * 100.0::DOUBLE / electors AS pct FROM counts JOIN u USING (unit_id) WHERE electors > 0),
b0 AS (SELECT unit_id, community, sum(pct) AS pct FROM (FROM s0 UNION ALL SELECT DISTINCT unit_id, k.community, 0 FROM s0, known k WHERE is_other) GROUP BY 1, 2),
b1 AS (SELECT b0.*, category, coalesce(is_other, false) AS is_other, census_sc, census_st, coalesce(sum(CASE WHEN category = 'SC' THEN pct END) OVER w, 0) AS own_SC, coalesce(sum(CASE WHEN category = 'ST' THEN pct END) OVER w, 0) AS own_ST
  FROM b0 LEFT JOIN known USING (community) JOIN u USING (unit_id) WINDOW w AS (PARTITION BY unit_id)),
{", ".join(steps)},
asked AS (SELECT c_nationkey AS unit_id, c_mktsegment AS community, count(*) AS n FROM customer WHERE c_nationkey % 6 = 0 GROUP BY 1, 2),
est AS (SELECT unit_id, community, pct AS est_pct, electors, floor(least(1.0::DOUBLE, 0.6::DOUBLE * least(1.0::DOUBLE, coalesce(matched / electors, 0)) + 0.2::DOUBLE * fresh + 0.2::DOUBLE * coalesce(confident / matched, 0)) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS confidence
  FROM {at} JOIN (SELECT unit_id, electors, matched, confident, fresh FROM u) USING (unit_id) WHERE pct > 0 AND unit_id NOT IN (SELECT unit_id FROM asked)
  UNION ALL SELECT unit_id, community, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY unit_id), electors, 0.9::DOUBLE FROM asked LEFT JOIN u USING (unit_id)),
blended AS (FROM est UNION ALL SELECT unit_id, 'UNMATCHED', 100.0::DOUBLE - sum(est_pct) AS p, any_value(electors), any_value(confidence) FROM est GROUP BY unit_id HAVING 100.0::DOUBLE - sum(est_pct) > 1e-9)"""


_SHARES = f"""shared AS (SELECT b.*, share_a, share_b FROM blended b LEFT JOIN (SELECT area_id AS unit_id, {PARTIES[0].lower()}_pct AS share_a, {PARTIES[1].lower()}_pct AS share_b FROM area_rollup WHERE kind = '{BASELINE[0]}' AND year = {BASELINE[1]}) USING (unit_id) WHERE confidence >= 0.4)"""
_CORR = lambda s: f"CASE WHEN count(*) FILTER ({s} IS NOT NULL) >= 4 AND var_pop(est_pct) * var_pop({s}) > 0 THEN corr(est_pct, {s}) END"
_ASSOCIATED = f"SELECT community, count(*) AS units, {_CORR('share_a')} AS r_a, {_CORR('share_b')} AS r_b, regr_slope(share_a, est_pct) AS slope, regr_intercept(share_a, est_pct) AS intercept FROM shared WHERE share_a IS NOT NULL GROUP BY 1 HAVING count(*) >= 4"
#: (source, destination, share): the scenario's transfer rows, written out.
_MOVES = f"""(VALUES ('{PARTIES[0]}', '{PARTIES[0]}', 1.0::DOUBLE), ('{PARTIES[1]}', '{PARTIES[1]}', 0.9::DOUBLE), ('{PARTIES[1]}', '{PARTIES[0]}', 0.1::DOUBLE), ('{PARTIES[2]}', '{PARTIES[1]}', 0.6::DOUBLE), ('{PARTIES[2]}', '{PARTIES[0]}', 0.4::DOUBLE),
  ('{PARTIES[3]}', '{PARTIES[3]}', 1.0::DOUBLE), ('IND', 'IND', 1.0::DOUBLE), ('NOTA', 'NOTA', 1.0::DOUBLE)) m(src, party, share)"""


def _draws() -> str:
    """The scenario's draws as a table of numbers: what the seed gives, written out. Sums, projection and ranks are the SQL's own."""
    matrix = S.transfer_matrix(S.Scenario(**SHIFT.__dict__), sorted({*PARTIES, "IND", "NOTA"}))
    side = {PAIR[0]: 1.0, PAIR[1]: -1.0}
    rows = (f"({d}, '{src}', {side[to] * w!r}::DOUBLE)" for d, src, to, w in S.draw_rows(SHIFT, matrix) if to in side)
    return f"(VALUES {', '.join(rows)}) m(draw, src, weight)"


_NEW_MARGIN = f"""SELECT sum(coalesce(n.additions, 0) * 0.6::DOUBLE * s.votes / s.valid_votes * CASE party WHEN '{PAIR[0]}' THEN 1 WHEN '{PAIR[1]}' THEN -1 ELSE 0 END) FROM party_share s LEFT JOIN new_voter_share n USING (contest_id, unit_id) WHERE kind = '{BASELINE[0]}' AND year = {BASELINE[1]}"""
#: h (id, simhash), in order of ids; kept: the sequential rule, one title after another.
SEQUENTIAL = f"""WITH RECURSIVE h AS MATERIALIZED (SELECT doc_id AS id, simhash FROM ({SIMHASH_SQL})),
  near AS (SELECT b.id, list(a.id) AS near FROM h a JOIN h b ON a.id < b.id AND bit_count(xor(a.simhash, b.simhash)) <= 3 GROUP BY 1),
  o AS MATERIALIZED (SELECT h.id, near, row_number() OVER (ORDER BY h.id) AS i FROM h LEFT JOIN near USING (id)),
  walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT o.i, CASE WHEN near IS NULL OR NOT list_has_any(kept, near) THEN list_append(kept, id) ELSE kept END FROM walk JOIN o ON o.i = walk.i + 1),
  last AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1))"""
SQL = {
    "dedupe_near": SEQUENTIAL + " SELECT id, simhash, last.id IS NOT NULL AS kept FROM h LEFT JOIN last USING (id)",
    "scen_monte_carlo": over_views(f"""SELECT round(max(margin) FILTER (i = 50), 1) AS p10, round(max(margin) FILTER (i = 250), 1) AS p50, round(max(margin) FILTER (i = 449), 1) AS p90, count(*) AS draws FROM (SELECT margin, row_number() OVER (ORDER BY margin, draw) - 1 AS i FROM (
  SELECT draw, sum(votes * weight) + ({_NEW_MARGIN}) AS margin FROM (SELECT party, sum(votes) AS votes FROM result_party WHERE kind = '{BASELINE[0]}' AND year = {BASELINE[1]} GROUP BY 1) JOIN {_draws()} ON src = party GROUP BY 1))"""),
    "topk_variance": over_views(f"""SELECT unit_id, round(stddev_pop(margin), 2) AS deviation FROM (SELECT unit_id, draw, sum(votes * weight) AS margin FROM result_party JOIN {_draws()} ON src = party WHERE kind = '{BASELINE[0]}' AND year = {BASELINE[1]} GROUP BY 1, 2) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""),
    "q_surnames": """WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS surname, p_type AS community FROM part), k AS (SELECT p_type AS community, max(p_size) AS category FROM part GROUP BY 1),
  d AS (SELECT surname, community, floor(count(*) * 10000 / sum(count(*)) OVER (PARTITION BY surname)) / 10000.0::DOUBLE AS weight FROM w GROUP BY 1, 2)
  SELECT surname, community, category, CASE community WHEN 'LARGE' THEN weight / 2 ELSE weight END AS weight FROM d JOIN k USING (community) WHERE surname ILIKE '%o%' ORDER BY 1, 2 LIMIT 500""",
    "xwalk_score": f"WITH {_PAIRS} SELECT group_id, station, anchor, score, capped FROM pairs WHERE station % 2 = 1",
    "xwalk_match": f"WITH {_PAIRS} SELECT * FROM forward",
    "xwalk_splits": f"WITH {_PAIRS} SELECT * FROM lineage",
    "xwalk_apply": f"WITH {_PAIRS} SELECT group_id, station, unit_uid, CASE WHEN method = 'new' THEN 'new' WHEN related THEN 'split' WHEN method = 'review' THEN 'fuzzy' ELSE method END AS match_method, score AS confidence, false AS reviewed FROM applied",
    "uid_mint": f"WITH {_PAIRS} SELECT * FROM minted",
    "xwalk_review": f"WITH {_PAIRS} SELECT group_id, station, unit_uid, method, score, runner_up, runner_score FROM applied WHERE method IN ('new', 'review')",
    "blend_surname": f"""WITH {_HIST} SELECT unit_id, community, CAST(floor(n + 0.5) AS BIGINT) AS est_count, floor(n / sum(n) OVER (PARTITION BY unit_id) * 10000.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS est_pct,
  floor(least(1.0::DOUBLE, confident / matched) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS confidence FROM counts JOIN quality USING (unit_id)""",
    "blend_booth": f"WITH {_HIST}, {_blended()} SELECT unit_id, community, round(est_pct, 6) AS est_pct, CAST(floor(est_pct * electors / 100.0::DOUBLE + {B.HALF}::DOUBLE) AS BIGINT) AS est_count, confidence FROM blended",
    "q_community": over_views(f"SELECT * FROM (WITH {_HIST}, {_blended()}, {_SHARES} SELECT unit_id, community, round(est_pct, 6) AS est_pct, confidence, share_a, share_b FROM shared)"),
    "q_community_correlation": over_views(f"SELECT * FROM (WITH {_HIST}, {_blended()}, {_SHARES} SELECT community, units, round(r_a, 6) AS r_a, round(r_b, 6) AS r_b, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM ({_ASSOCIATED}))"),
    "crib_6": over_views(f"SELECT * FROM (WITH {_HIST}, {_blended()}, {_SHARES} SELECT community, round(round(r_a, 6), 3) AS r_a, round(round(r_b, 6), 3) AS r_b, units FROM ({_ASSOCIATED}))"),
    "scen_project": over_views(f"""SELECT party, round(votes, 4) AS votes, CASE WHEN party != 'NOTA' THEN CAST(row_number() OVER (ORDER BY party != 'NOTA' DESC, votes DESC, party) AS INT) END AS place FROM (SELECT party, sum(v) AS votes FROM (
  SELECT m.party, sum(p.votes * m.share * 0.95::DOUBLE) AS v FROM result_party p JOIN {_MOVES} ON p.party = m.src WHERE kind = '{BASELINE[0]}' AND year = {BASELINE[1]} GROUP BY 1
  UNION ALL SELECT party, sum(coalesce(n.additions, 0) * 0.6::DOUBLE * s.votes / s.valid_votes) FROM party_share s LEFT JOIN new_voter_share n USING (contest_id, unit_id) WHERE kind = '{BASELINE[0]}' AND year = {BASELINE[1]} GROUP BY 1) GROUP BY 1)"""),
    "math_largest_remainder": """WITH c AS (SELECT n_regionkey AS region, c_nationkey AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), e AS (SELECT *, 1000 * n / sum(n) OVER (PARTITION BY region) AS x FROM c)
SELECT region, nation, CAST(floor(x) + CASE WHEN row_number() OVER (PARTITION BY region ORDER BY floor(x) - x, nation) <= 1000 - sum(floor(x)) OVER (PARTITION BY region) THEN 1 ELSE 0 END AS BIGINT) AS seats FROM e""",
    "vec_search": """SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, v.vec_id) AS INT) AS place FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0) WHERE place <= 10""",
}
