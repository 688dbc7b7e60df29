"""Views by hand, and algorithms against plain Python."""

import math
import random
import statistics

from pyspark.sql import functions as F

from contestlab.functions import text as T
from contestlab.model import ContestData
from contestlab.operators import blend, dedupe, match, scenario
from contestlab.plans.views import Views, ntile_in, refresh


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def three_units(spark):
    """Three units, two contests of one kind; in the first C stands in for what the second lacks."""
    units = spark.createDataFrame([(u, 1, 10, 100, e, r, 1.0, True, None) for u, e, r in (("A", 1500, 12), ("B", 1400, 8), ("C", 1600, 0))], "unit_id string, group_id int, area_id int, block_id int, electors int, rejected int, confidence double, reviewed boolean, lineage_kind string")
    now = {"A": (500, 400, 80, 20), "B": (300, 600, 90, 10), "C": (450, 450, 95, 5)}
    old = {"A": (450, 430, 100, 20), "B": (350, 550, 90, 10), "C": (400, 480, 115, 5)}
    rows = [(1, c, "VS", y, u, p, p, p, v, 1.0, True) for c, y, table in ((2, 2024, now), (1, 2019, old)) for u, vs in table.items() for p, v in zip(("P", "Q", "R", "NOTA"), vs, strict=True)]
    rows += [(1, 1, "VS", 2019, "A", "Gone", "G", "G", 7, 1.0, True)]
    votes = spark.createDataFrame(rows, "group_id int, contest_id long, kind string, year int, unit_id string, candidate string, party string, contestant string, votes long, confidence double, reviewed boolean")
    contests = spark.createDataFrame([(1, 1, "VS", 2019, False, "P", "Q"), (1, 2, "VS", 2024, True, "P", "Q")], "group_id int, contest_id long, kind string, year int, is_baseline boolean, party_a string, party_b string")
    empty = lambda s: spark.createDataFrame([], s)
    return ContestData(units, votes, contests, empty("unit_id string, day date, additions long, deletions long, modifications long"), empty("unit_id string, day date, electors int"), empty("contest_id long, group_id int, kind string, year int, day date"))


def test_golden_views(spark, tmp_path):
    v = Views(three_units(spark), parties=("P", "Q", "R"))
    took = refresh(v, str(tmp_path))
    assert set(took) == {"result_candidate", "result_party", "totals", "party_share", "wide", "swing", "swing_vanished", "transfer", "floating_vote", "volatility", "new_voter_share", "priority", "area_rollup", "group_summary", "joint_segments"}
    wide = {r.unit_id: r for r in v.wide.filter("year = 2024").collect()}
    assert {u: (r.valid_votes, r.votes_polled, r.signed_margin_pct) for u, r in wide.items()} == {"A": (1000, 1012, 10.0), "B": (1000, 1008, -30.0), "C": (1000, 1000, 0.0)}
    assert wide["C"].winner_party == "P"  # a tie goes by name
    (g,) = v.group_summary.filter("year = 2024").collect()
    assert (g.winner_party, g.winner_votes, g.runner_votes, g.margin_votes) == ("Q", 1450, 1250, 200)
    assert v.swing.filter("year = 2019 and prev_share_pct is not null").count() == 0
    assert [tuple(r)[5:] for r in v.swing_vanished.collect()] == [("G", 1, 0.0, 0.7, -0.7, -7)]
    assert v.floating_vote.filter("floating_pct is not null").count() == 0  # one kind only
    assert v.new_voter_share.count() == 0
    p = {r.unit_id: r for r in v.priority.collect()}
    assert p["C"].priority_quartile == 1 and p["C"].inputs_used == "closeness,volatility"
    stored = Views.stored(spark, str(tmp_path), three_units(spark), parties=("P", "Q", "R"))
    assert found(stored.priority) == sorted(map(tuple, p.values()), key=str) and stored.wide.count() == 6


def test_refresh_again_gives_the_same(spark, tmp_path):
    from contestlab.operators.quality import digest

    a, b = Views(three_units(spark)), Views(three_units(spark))
    refresh(a, str(tmp_path / "a"), ("wide", "priority"))
    assert digest(a.priority).first() == digest(b.priority).first()


def test_ntile_like_the_window(spark):
    df = spark.range(23).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), F.when(F.col("id") % 5 != 0, F.col("id") % 4).alias("v"))
    got = {(r.g, r.k): r.t for r in ntile_in(df, "g", "k", "v", "t").collect()}
    df.createOrReplaceTempView("nt")
    want = {(r.g, r.k): r.t for r in spark.sql("SELECT g, k, ntile(4) OVER (PARTITION BY g ORDER BY v DESC, k) AS t FROM nt WHERE v IS NOT NULL").collect()}
    assert {x: t for x, t in got.items() if t is not None} == want


VOTES = {"u1": {"P": 500, "Q": 400, "R": 80, "NOTA": 20}, "u2": {"P": 300, "Q": 620, "R": 90}, "u3": {"P": 52310, "Q": 48990, "R": 7420, "NOTA": 1310}}
ADDED = {"u1": 30, "u2": 0, "u3": 10}


def votes(spark):
    return spark.createDataFrame([(u, p, n, ADDED[u]) for u, row in VOTES.items() for p, n in row.items()], "unit_id string, party string, votes long, additions long")


def brute_draws(s, parties):
    """Totals and unit margins of each draw, one unit after another."""
    matrix = scenario.transfer_matrix(s, parties)
    weights = {}
    for d, src, to, w in scenario.draw_rows(s, matrix):
        weights.setdefault(d, []).append((src, to, w))
    out = []
    for d in sorted(weights):
        margins = {}
        for u, row in VOTES.items():
            local = {}
            for src, to, w in weights[d]:
                local[to] = local.get(to, 0) + row.get(src, 0) * w
            for p, n in row.items():
                local[p] = local.get(p, 0) + ADDED[u] * s.new_turnout * n / sum(row.values())
            margins[u] = local.get(s.contest[0], 0) - local.get(s.contest[1], 0)
        out.append(margins)
    return out


def test_scenario(spark):
    df, status_quo = votes(spark), scenario.Scenario(contest=("P", "Q"), new_turnout=0.0)
    rows = {r.party: r for r in scenario.project(df, status_quo).collect()}
    assert round(rows["P"].votes - rows["Q"].votes, 6) == 3100 and rows["P"].place == 1 and rows["NOTA"].place is None
    moved = {r.party: r.votes for r in scenario.project(df, scenario.Scenario(contest=("P", "Q"), new_turnout=0.0, transfer=scenario.one_way("R", "Q", 1.0, "P"))).collect()}
    assert moved["Q"] > moved["P"] and moved["R"] == 0
    s = scenario.Scenario(contest=("P", "Q"), transfer={"R": {"Q": 0.6, "P": 0.4}}, draws=60)
    brute = brute_draws(s, ["NOTA", "P", "Q", "R"])
    margins = sorted(sum(m.values()) for m in brute)
    got = scenario.band(df, s).first()
    for p, x in ((0.1, got.p10), (0.5, got.p50), (0.9, got.p90)):
        assert abs(margins[min(59, round(p * 59))] - x) <= 0.051
    spread = {u: statistics.pstdev(m[u] for m in brute) for u in VOTES}
    assert all(math.isclose(r.deviation, spread[r.unit_id], abs_tol=0.006) for r in scenario.most_variable(df, s).collect())
    assert scenario.band(df, scenario.Scenario(contest=("P", "Q"), noise=0.0, draws=5)).select(F.col("p90") - F.col("p10")).first()[0] == 0
    split = scenario.Scenario(contest=("P", "Q"), new_split={"Q": 1.0}, new_turnout=1.0)
    assert {r.party: r.votes for r in scenario.project(df, split).collect()}["Q"] == 50010 + 40


def test_transfer_matrix():
    s = scenario.Scenario(contest=("P", "Q"), transfer={"bloc": {"Q": 1}, "R": {"bloc2": 2, "P": 2}}, alliance={"R": "bloc", "S": "bloc", "P": "bloc2", "Q": "bloc2"}, sympathy=0.25)
    assert scenario.transfer_matrix(s, ["P", "Q", "R", "S"]) == {"P": {"P": 1.0}, "Q": {"Q": 0.75, "P": 0.25}, "R": {"P": 0.75, "Q": 0.25}, "S": {"Q": 1.0}}


def test_allocation_is_exact(spark):
    df = spark.createDataFrame([("a", 10, w, i) for i, w in enumerate((1.0, 1.0, 1.0, 0.0))] + [("b", 5, 0.0, 9)], "g string, total long, w double, k int")
    assert [r.seats for r in scenario.allocate(df, "g", "total", "w", "k").filter("g = 'a'").orderBy("k").collect()] == [4, 3, 3, 0]


def test_first_seen_is_the_sequential_rule(spark):
    rng = random.Random(5)
    hashes = [rng.getrandbits(64) for _ in range(25)]
    for _ in range(120):  # chains of small changes
        h = rng.choice(hashes)
        for _ in range(rng.randrange(3)):
            h ^= 1 << rng.randrange(64)
        hashes.append(h)
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    kept = []
    for i, h in enumerate(hashes):
        if not any((h ^ hashes[j]).bit_count() <= 3 for j in kept):
            kept.append(i)
    df = spark.createDataFrame(list(enumerate(signed)), "id long, simhash long")
    assert sorted(r.id for r in dedupe.first_seen(df).filter("kept").collect()) == kept
    assert dedupe.first_seen(df.limit(0)).count() == 0


def test_links_settle_alike_in_rounds_and_in_order(spark):
    rng = random.Random(6)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)} | {(100 + i, 101 + i) for i in range(14)})
    want = set()
    for v, u in sorted((v, u) for u, v in edges):
        if u not in want:
            want.add(v)
    df = dedupe.written(spark.createDataFrame(edges, "u long, v long"), "edges")
    for few in (0, 1000):
        assert {r.id for r in dedupe.settle(df, few).collect()} == want
    chain = dedupe.written(spark.range(20_000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")), "chain")
    assert dedupe.settle(chain).count() == 10_000  # every second one, in one step


def test_vector_search_ignores_zero_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = dedupe.vector_search(df, df.filter("vec_id != 2").withColumnRenamed("vec_id", "query_id"), k=5)
    assert [(r.query_id, r.vec_id, round(r.similarity, 5)) for r in got.orderBy("place").collect()] == [(1, 1, 1.0), (1, 2, 0.6)]


def test_names(spark):
    df = spark.createDataFrame([("प्रा०वि० चतरो (उत्तरी भाग)", "महतो"), ("Primary School Chatro Part-2", "Zoë  Ltd."), (None, None)], "a string, b string")
    got = found(df.select(T.canonical_building(F.col("a")), T.building_type(T.canonical_building(F.col("a"))), T.to_latin(F.col("b")), T.fold(F.col("b"))))
    assert got == sorted([("PRIMARY_SCHOOL चतरो", "PRIMARY_SCHOOL", "mahato", "महतो"), ("PRIMARY_SCHOOL chatro", "PRIMARY_SCHOOL", "zoë ltd.", "zoë ltd"), ("", None, "", "")], key=str)
    assert round(T.jaro_winkler("martha", "marhta"), 4) == 0.9611 and T.jaro_winkler("abc", None) == 0.0 and T.jaro_winkler("", "a") == 0.0
    assert T.simhash64(None) == 0 == T.simhash64("") and T.simhash64("ab") != 0
    r = spark.range(1).select(T.parse_int(F.lit("१,२३ x")).alias("a"), T.parse_int(F.lit("none")).alias("b"), T.bracket_text(F.lit("A (b) [c d]")).alias("c"), T.url_hash(F.lit("HTTP://a.org/x/?q#f")) == T.url_hash(F.lit("http://a.org/x"))).first()
    assert tuple(r) == (123, None, "c d", True)


def test_headers_to_candidates(spark):
    headers = ["NOTA", "Asha Devi (XY)", "Ravi Kumat", "Ravi Kumar", "Unknown Person (Independent)", "Total Stranger", "Someone (AB)"]
    candidates = [(1, "Asha Devi", "XY"), (2, "Ravi Kumar", "AB"), (3, "Ravi Kumari", "AB"), (4, "Sunil Mehta", "CD")]
    h = spark.createDataFrame([(1, i, x) for i, x in enumerate(headers)], "contest_id int, column int, header string")
    c = spark.createDataFrame([(1, *x) for x in candidates], "contest_id int, candidate_id int, name string, party string")
    a = spark.createDataFrame([("xy", "XY"), ("A.B.", "AB"), ("AB", "AB")], "alias string, party string")
    got = {r.column: (r.method, r.candidate_id, r.party) for r in match.resolve_columns(h, c, a).collect()}
    assert got[0] == ("nota", None, "NOTA") and got[1] == ("alias+name", 1, "XY")
    assert got[2][0] == got[3][0] == "unresolved"  # two candidates are too alike
    assert got[4] == ("independent", None, "IND") and got[5][0] == "unresolved" and got[6] == ("alias", None, "AB")


def test_stations(spark):
    s = "group_id int, station int, building string, place string, part int"
    old = spark.createDataFrame([(1, 1, "Primary School Chatro", "chatro", 5), (1, 2, "Middle School Chatro", "chatro", None), (2, 3, "Alone", None, None)], s)
    anchors = spark.createDataFrame([(1, 7, "P.S. Chatro", "chatro", 5), (1, 8, "High School Chatro", "chatro", 6)], s)
    got = {r.station: r for r in match.match_stations(old, anchors).collect()}
    assert (got[1].method, got[1].anchor, got[1].score) == ("exact", 7, 1.0)
    assert got[2].method == "new" and got[2].anchor is None and got[2].score <= match.CAP
    assert got[3].method == "new" and got[3].score == 0.0
    minted = match.mint_ids(spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "group_id int, station int"), spark.createDataFrame([(1, "1-B0041")], "group_id int, unit_uid string"))
    assert found(minted) == [(1, 2, "1-B0042"), (2, 3, "2-B0001"), (2, 4, "2-B0002")]
    areas = spark.createDataFrame([("Ward 7", 70), ("चतरो", 71)], "alias string, area_id int")
    assert found(match.resolve_areas(spark.createDataFrame([("WARD-7",), ("nowhere",)], "name string"), areas)) == [("WARD-7", 70), ("nowhere", None)]


def test_blend(spark):
    units = spark.createDataFrame([(1, 100, 80.0, 40.0, 35.0, None, 2011), (2, 100, 50.0, 50.0, None, None, None), (3, 100, 0.0, 0.0, 20.0, None, 2011)], "unit_id int, electors int, matched double, confident double, census_sc double, census_st double, census_year int")
    counts = spark.createDataFrame([(1, "x", 15.0), (1, "y", 65.0), (2, "y", 50.0), (3, "y", 40.0)], "unit_id int, community string, n double")
    communities = spark.createDataFrame([("x", "SC", False), ("y", "GEN", False), ("other", "SC", True)], "community string, category string, is_other boolean")
    survey = spark.createDataFrame([(2, "x", 3), (2, "y", 1)], "unit_id int, community string, n int")
    rows = {(r.unit_id, r.community): (round(r.est_pct, 6), r.confidence) for r in blend.blend(units, counts, communities, survey, 2026).collect()}
    assert rows[1, "x"][0] == 21.0 and rows[1, "y"][0] == 59.0 and rows[1, blend.UNMATCHED][0] == 20.0  # 0.7 * 15 + 0.3 * 35
    assert rows[1, "x"][1] == round(0.6 * 0.8 + 0.2 * 0.25 + 0.2 * 0.5, 3)
    assert rows[2, "x"] == (75.0, 0.9) and (2, blend.UNMATCHED) not in rows
    assert rows[3, "other"][0] == 6.0 and rows[3, "y"][0] == 34.0 and rows[3, blend.UNMATCHED][0] == 60.0


def test_numbers_of_new_stations_are_never_cut(spark):
    new = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 1)], "group_id int, station int")
    taken = spark.createDataFrame([(1, "1-B9996"), (1, "1-B0003"), (2, "2-B123456")], "group_id int, unit_uid string")
    got = [r.unit_uid for r in match.mint_ids(new, taken).orderBy("group_id", "station").collect()]
    assert got == ["1-B9997", "1-B9998", "1-B9999", "1-B10000", "1-B10001", "1-B10002", "1-B10003", "1-B10004", "1-B10005", "2-B123457"] and len(set(got)) == 10


def test_new_areas_need_a_block(spark):
    names = spark.createDataFrame([("Ward 7", 1), ("WARD-8", 2), ("ward 8", 1), ("nowhere", None), ("", 3), ("Zeta", 5)], "name string, block_id int")
    areas = spark.createDataFrame([("ward 7", 70)], "alias string, area_id int")
    assert found(match.new_areas(names, areas)) == [(71, 1, "ward 8", "ward 8"), (72, 5, "Zeta", "zeta")]


def test_closest_candidates(spark):
    h = spark.createDataFrame([(1, 5, "Ravi Kumar"), (2, 6, "Nobody")], "contest_id int, column int, header string")
    c = spark.createDataFrame([(1, i, n) for i, n in enumerate(("Ravi Kumari", "Asha Devi", "Ravi Kumar", "Ravee Kumar", "Zed"))], "contest_id int, candidate_id int, name string")
    got = [(r.column, r.candidate_id, r.place) for r in match.closest_candidates(h, c).orderBy("place").collect()]
    assert got == [(5, 2, 1), (5, 3, 2), (5, 0, 3)]


def test_text_functions_in_sql(spark):
    T.register(spark)
    texts = ["महतो", "प्रा०वि० चतरो", "Zoë  Ltd.", None, "क़लम a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df.createOrReplaceTempView("some_texts")
    rows = spark.sql("SELECT to_latin(t) AS a, simhash64(t) AS h, round(jaro_winkler('martha', 'marhta'), 4) AS j FROM some_texts").collect()
    assert [r.a for r in rows] == [r[0] for r in df.select(T.to_latin(F.col("t"))).collect()] and rows[3].h == 0 and rows[0].j == 0.9611
