"""What-if projections of a result: transfers between parties, turnout, new voters, and a band of noisy draws.

The projection is linear in the votes, so draws never meet units: party totals are summed once and joined with
the draws' transfer rows, and a unit's spread over all draws is a quadratic form of its votes with the draws'
covariance. The driver holds parties and draws only, MAX_DRAWS at most.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTA = "NOTA"
MAX_DRAWS, MAX_PARTIES = 2000, 64


@dataclass
class Scenario:
    """transfer: {party or alliance: {party or alliance: share}}; contest: the pair whose margin is measured."""

    contest: tuple[str, str]
    transfer: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    alliance: Mapping[str, str] = field(default_factory=dict)
    turnout: float = 1.0
    sympathy: float = 0.0
    new_split: Mapping[str, float] | None = None
    new_turnout: float = 0.6
    draws: int = 500
    noise: float = 0.05
    seed: int | None = 42


def _whole(row: Mapping[str, float], own: str) -> dict[str, float]:
    row = {k: max(0.0, v) for k, v in row.items()}
    total = sum(row.values())
    return {k: v / total for k, v in row.items()} if total > 0 else {own: 1.0}


def transfer_matrix(s: Scenario, parties: list[str]) -> dict[str, dict[str, float]]:
    """A full row for each party. A party's own row beats its alliance's; an alliance as destination is split equally."""
    members: dict[str, list[str]] = {}
    for party, name in s.alliance.items():
        members.setdefault(name, []).append(party)
    matrix = {}
    for party in parties:
        given = s.transfer.get(party, s.transfer.get(s.alliance.get(party, "")))
        row: dict[str, float] = {}
        for to, share in (given or {}).items():
            for one in [to] if to in parties else members.get(to, [to]):
                row[one] = row.get(one, 0.0) + share / (1 if to in parties else len(members.get(to, [to])))
        matrix[party] = _whole(row, party) if row else {party: 1.0}
    a, b = s.contest
    if s.sympathy and b in matrix:
        swing, row = max(-1.0, min(1.0, s.sympathy)), dict(matrix[b])
        source, goal = (b, a) if swing > 0 else (a, b)
        moved = row.get(source, 0.0) * abs(swing)
        row[source], row[goal] = row.get(source, 0.0) - moved, row.get(goal, 0.0) + moved
        matrix[b] = row
    return matrix


def draw_rows(s: Scenario, matrix: dict[str, dict[str, float]]) -> list[tuple[int, str, str, float]]:
    """(draw, source, destination, weight), with random numbers taken in a fixed order: rows, turnout, source totals."""
    if not 1 <= s.draws <= MAX_DRAWS:
        raise ValueError(f"1 to {MAX_DRAWS} draws")
    rng, out = random.Random(s.seed), []
    for draw in range(s.draws):
        noisy = {}
        for src, row in matrix.items():
            if len(row) > 1:
                row = {to: share * math.exp(rng.uniform(-s.noise, s.noise)) if share > 0 else 0.0 for to, share in row.items()}
            noisy[src] = _whole(row, src)
        scale = s.turnout * (1 + rng.uniform(-s.noise, s.noise))
        scale *= 1 + rng.uniform(-s.noise, s.noise)
        out += [(draw, src, to, share * scale) for src, row in noisy.items() for to, share in row.items()]
    return out


def new_votes(votes: DataFrame, s: Scenario) -> DataFrame:
    """party, new: votes of additions (one number a unit) by the given split, or by each unit's own shares."""
    if s.new_split:
        once = votes.groupBy("unit_id").agg(F.max("additions").alias("n")).agg(F.sum("n").alias("n"))
        parts = F.explode(F.array(*(F.struct(F.lit(p).alias("party"), F.lit(float(x)).alias("share")) for p, x in s.new_split.items()))).alias("p")
        return once.select(parts, "n").select("p.party", (F.col("n") * s.new_turnout * F.col("p.share")).alias("new"))
    share = F.try_divide(F.col("votes"), F.sum("votes").over(Window.partitionBy("unit_id")))
    return votes.withColumn("new", F.col("additions") * s.new_turnout * share).groupBy("party").agg(F.sum("new").alias("new"))


def _edges(like: DataFrame, rows: list[tuple]) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, "draw int, src string, party string, weight double")


def parties_of(votes: DataFrame) -> list[str]:
    found = sorted(r[0] for r in votes.select("party").distinct().limit(MAX_PARTIES + 1).collect())
    if len(found) > MAX_PARTIES:
        raise ValueError(f"more than {MAX_PARTIES} parties: merge the small ones first")
    return found


def project_totals(votes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """draw, party, votes. votes: unit_id, party, votes, additions."""
    totals = votes.groupBy(F.col("party").alias("src")).agg(F.sum("votes").alias("n"))
    moved = edges.join(totals, "src").select("draw", "party", (F.col("weight") * F.col("n")).alias("votes"))
    added = edges.select("draw").distinct().crossJoin(F.broadcast(new)).select("draw", "party", F.col("new").alias("votes"))
    return moved.unionByName(added).groupBy("draw", "party").agg(F.sum("votes").alias("votes"))


def project(votes: DataFrame, s: Scenario) -> DataFrame:
    """party, votes, place: the point projection, with NOTA never placed."""
    matrix = transfer_matrix(s, parties_of(votes))
    edges = _edges(votes, [(0, src, to, share * s.turnout) for src, row in matrix.items() for to, share in row.items()])
    rows = project_totals(votes, edges, new_votes(votes, s)).select("party", "votes")
    real = ~F.col("party").eqNullSafe(F.lit(NOTA))
    place = F.row_number().over(Window.orderBy(real.desc(), F.desc("votes"), "party"))  # parties: MAX_PARTIES rows
    return rows.withColumn("place", F.when(real, place))


def party_sums(votes: DataFrame, s: Scenario) -> dict[str, tuple[float, float]]:
    """Votes, and new votes, of each party, in one job: all that draws need of the units, a row a party."""
    own = votes.groupBy("party").agg(F.sum("votes").cast("double").alias("votes"), F.lit(0.0).alias("new"))
    new = new_votes(votes, s).select("party", F.lit(0.0).alias("votes"), F.col("new").cast("double").alias("new"))
    rows = own.unionByName(new).groupBy("party").agg(F.sum("votes").alias("votes"), F.sum("new").alias("new")).limit(MAX_PARTIES + 1).collect()
    if len(rows) > MAX_PARTIES:
        raise ValueError(f"more than {MAX_PARTIES} parties: merge the small ones first")
    return {r["party"]: (r["votes"] or 0.0, r["new"] or 0.0) for r in rows}


def band(votes: DataFrame, s: Scenario) -> DataFrame:
    """p10, p50, p90 (nearest rank) of the pair's margin over the draws, and their number. Units are summed by party first; the draws are numbers of parties alone."""
    sums, (a, b) = party_sums(votes, s), s.contest
    side = {a: 1.0, b: -1.0}
    added = sum(side.get(p, 0.0) * new for p, (_, new) in sums.items())
    margins = [added] * s.draws
    for draw, src, to, weight in draw_rows(s, transfer_matrix(s, sorted(p for p in sums if p is not None))):
        if to in side:
            margins[draw] += side[to] * weight * sums.get(src, (0.0, 0.0))[0]
    margins.sort()
    at = lambda p: round(margins[min(s.draws - 1, round(p * (s.draws - 1)))], 1)
    return votes.sparkSession.createDataFrame([(at(0.10), at(0.50), at(0.90), s.draws)], "p10 double, p50 double, p90 double, draws long")


def most_variable(votes: DataFrame, s: Scenario, limit: int = 20) -> DataFrame:
    """unit_id, deviation: the units whose margin spreads most over the draws."""
    parties = parties_of(votes)
    place, (a, b) = {p: i for i, p in enumerate(parties)}, s.contest
    c = np.zeros((s.draws, len(parties)))
    for draw, src, to, weight in draw_rows(s, transfer_matrix(s, parties)):
        c[draw, place[src]] += weight * ((to == a) - (to == b))
    spread = np.cov(c.T, bias=True).reshape(len(parties), len(parties))
    units = votes.groupBy("unit_id").agg(*(F.coalesce(F.sum(F.when(F.col("party") == p, F.col("votes"))), F.lit(0)).alias(f"v{i}") for i, p in enumerate(parties)))
    terms = [F.col(f"v{i}") * F.col(f"v{j}") * float(spread[i, j] * (1 if i == j else 2)) for i in range(len(parties)) for j in range(i, len(parties)) if spread[i, j]]
    square = reduce(Column.__add__, terms, F.lit(0.0))
    rows = units.select("unit_id", F.round(F.sqrt(F.greatest(square, F.lit(0.0))), 2).alias("deviation"))
    return rows.orderBy(F.desc("deviation"), "unit_id").limit(limit)


def one_way(party: str, to: str, share: float, rest: str) -> dict[str, dict[str, float]]:
    """So much of one party's vote to a second one, what is left to a third."""
    share = max(0.0, min(1.0, share))
    return {party: {to: share, rest: 1.0 - share}}


def allocate(df: DataFrame, group: str, total: str, weight: str, key: str, out: str = "seats") -> DataFrame:
    """Whole numbers that add up to each group's total, by largest remainder; ties to the smaller key."""
    w = Window.partitionBy(group)
    exact = F.try_divide(F.col(total) * F.col(weight), F.sum(weight).over(w))
    rows = df.withColumn("_exact", F.coalesce(exact, F.lit(0.0))).withColumn("_floor", F.floor("_exact"))
    rows = rows.withColumn("_left", F.col(total) - F.sum("_floor").over(w)).withColumn("_place", F.row_number().over(w.orderBy((F.col("_floor") - F.col("_exact")), key)))
    return rows.withColumn(out, (F.col("_floor") + (F.col("_place") <= F.col("_left")).cast("long")).cast("long")).drop("_exact", "_floor", "_left", "_place")
