"""The derived views: one lazily composed DataFrame each, built on one another.

All fact views are keyed by (contest_id, unit_id), so that one shuffle on that key serves totals, ranking and
pivots. Ranks within a group never gather the group: values have two places, so they are counted first and
only the counts of distinct values are ordered.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestlab.functions import metrics as M
from contestlab.model import PARTIES, ContestData
from contestlab.operators.temporal import in_windows

NOTA = "NOTA"
CELL = ["group_id", "contest_id", "kind", "year", "unit_id"]
#: Each view after those that it reads.
ORDER = ("result_candidate", "result_party", "totals", "party_share", "wide", "swing", "swing_vanished", "transfer", "floating_vote", "volatility", "new_voter_share", "priority", "area_rollup", "group_summary", "joint_segments")

#: Those that others read by unit.
BY_UNIT = ("result_candidate", "result_party", "party_share", "wide", "transfer", "floating_vote", "volatility")


def is_not(column: str, value: str) -> Column:
    """IS DISTINCT FROM."""
    return ~F.col(column).eqNullSafe(F.lit(value))


def percent_ranks_in(df: DataFrame, group: str, keys: list[str], values: Mapping[str, str]) -> DataFrame:
    """df with, for each value (its column: the new one), the share of the other values in its group that are smaller. NULL values have none and don't count.

    All values go through one count, one window over the counts of distinct values, and one join back by keys.
    """
    each = F.array(*(F.struct(F.lit(i).alias("_i"), F.col(v).cast("double").alias("_v")) for i, v in enumerate(values)))
    rows = df.select(group, *(k for k in keys if k != group), F.explode(each).alias("_r")).select(group, *(k for k in keys if k != group), "_r.*").filter("_v is not null")
    counts = rows.groupBy(group, "_i", "_v").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(group, "_i").orderBy("_v")
    ranks = counts.select(group, "_i", "_v", (F.sum("_n").over(order) - F.col("_n")).alias("_below"), F.sum("_n").over(Window.partitionBy(group, "_i")).alias("_all"))
    ranks = ranks.filter("_all >= 2").select(group, "_i", "_v", (F.col("_below") / (F.col("_all") - 1)).alias("_rank"))
    found = rows.join(ranks, [group, "_i", "_v"]).groupBy(*keys).agg(*(F.max(F.when(F.col("_i") == i, F.col("_rank"))).alias(out) for i, out in enumerate(values.values())))
    return df.join(found, keys, "left")


def ntile_in(df: DataFrame, group: str, key: str, value: str, out: str, n: int = 4) -> DataFrame:
    """df with out: the n-tile of value, largest first, ties by key; NULL values have none and don't count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(group).orderBy(F.desc(value))
    places = counts.select(group, value, (F.sum("_n").over(order) - F.col("_n")).alias("_above"), F.sum("_n").over(Window.partitionBy(group)).alias("_all"))
    # rows without a value need no place, and are not to meet in one task
    apart = F.when(F.col(value).isNull(), F.pmod(F.xxhash64(key), F.lit(1 << 16)))
    own = F.row_number().over(Window.partitionBy(group, value, apart).orderBy(key))
    q, r, place = F.floor(F.col("_all") / n), F.col("_all") % n, F.col("_above") + F.col("_own") - 1
    wide = r * (q + 1)
    tile = F.when(place < wide, F.floor(place / (q + 1)) + 1).otherwise(F.floor((place - wide) / F.greatest(q, F.lit(1))) + r + 1)
    return df.withColumn("_own", own).join(places, [group, value], "left").withColumn(out, tile.cast("int")).drop("_own", "_above", "_all")


class Views:
    """All views of one ContestData. parties: those with a column of their own in wide rows."""

    #: Whether those that are read are stored in buckets of units.
    lie_by_unit = False

    def __init__(self, data: ContestData, parties: Sequence[str] = PARTIES, exclude_nota: bool = False, strict_adjacent: bool = True):
        self.data, self.parties, self.exclude_nota, self.strict = data, tuple(parties), exclude_nota, strict_adjacent
        self._kept: list[DataFrame] = []

    def _shared(self, df: DataFrame) -> DataFrame:
        """Kept by the executors, as several parts of one view read it; let go with release()."""
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def release(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()

    def held_by(self, df: DataFrame) -> DataFrame:
        """df; what the views keep in the executors is let go when nobody holds df any more, but for the end of the program, which lets go of all."""
        weakref.finalize(df, self.release).atexit = False
        return df

    @classmethod
    def stored(cls, spark: SparkSession, path: str, data: ContestData, **options) -> Views:
        """The views that refresh() wrote to path, as scans."""
        views = cls(data, **options)
        for name in ORDER:
            views.__dict__[name] = spark.read.parquet(f"{path}/{name}")
        return views

    def __getitem__(self, name: str) -> DataFrame:
        if name not in ORDER:
            raise KeyError(name)
        return getattr(self, name)

    @cached_property
    def result_candidate(self) -> DataFrame:
        return self.data.votes

    @cached_property
    def result_party(self) -> DataFrame:
        return self.result_candidate.groupBy(*CELL, "party").agg(F.sum("votes").alias("votes"))

    @cached_property
    def totals(self) -> DataFrame:
        real = is_not("party", NOTA)
        return self.result_candidate.groupBy(*CELL).agg(
            F.sum("votes").alias("valid_votes"),
            F.sum(F.when(~real, F.col("votes"))).alias("nota"),
            F.sum(F.when(real, F.col("votes"))).alias("candidate_votes"),
            F.sum(real.cast("long")).alias("contestants"),
        )

    @cached_property
    def party_share(self) -> DataFrame:
        """Totals come from the party rows themselves: a window on the key that they are grouped by."""
        whole = F.sum("votes").over(Window.partitionBy(*CELL))
        return self.result_party.select(*CELL, "party", "votes", whole.alias("valid_votes")).withColumn("share_pct", M.share_pct(F.col("votes"), F.col("valid_votes")))

    @cached_property
    def ranked(self) -> DataFrame:
        """Contestants with their place; NOTA has none."""
        real = is_not("party", NOTA)
        order = Window.partitionBy(*CELL).orderBy(real.desc(), F.desc("votes"), "contestant")
        return self.result_candidate.withColumn("place", F.when(real, F.row_number().over(order)))

    @cached_property
    def wide(self) -> DataFrame:
        p, v, own = F.col("party"), F.col("votes"), [*self.parties, NOTA]
        first, second = F.col("place") == 1, F.col("place") == 2
        top = lambda c, w: F.max(F.when(w, F.col(c)))
        cells = self.ranked.groupBy(*CELL).agg(
            F.sum(v).alias("valid_votes"),
            F.sum(F.when(p == NOTA, v)).alias("nota"),
            *(F.sum(F.when(p == x, v)).alias(x.lower()) for x in self.parties),
            F.sum(F.when(~p.isin(*own) | p.isNull(), v)).alias("others"),
            top("contestant", first).alias("winner_party"),
            top("candidate", first).alias("winner_candidate"),
            top("votes", first).alias("winner_votes"),
            top("contestant", second).alias("runner_party"),
            top("votes", second).alias("runner_votes"),
            F.count("place").alias("contestants"),
        )
        units = self.data.units.select("unit_id", "area_id", "block_id", "electors", "rejected", "lineage_kind")
        # one row per group and contest: contests, not units, bound it
        pair = self.data.contests.select("contest_id", "party_a", "party_b")
        rows = cells.join(units, "unit_id").join(F.broadcast(pair), "contest_id", "left")
        w, r, n, valid = (F.col(x) for x in ("winner_votes", "runner_votes", "contestants", "valid_votes"))
        polled = M.votes_polled(valid, F.col("rejected"))
        return rows.select(
            *CELL, "area_id", "block_id", "electors", "valid_votes", polled.alias("votes_polled"), "rejected", "nota", *(x.lower() for x in self.parties), "others",
            "winner_party", "winner_candidate", "winner_votes", "runner_party", "runner_votes", "contestants",
            M.margin_votes(w, r, n).alias("margin_votes"),
            M.margin_pct(w, r, n, valid).alias("margin_pct"),
            M.signed_margin_pct(F.col("winner_party"), w, r, n, valid, F.col("party_a"), F.col("party_b")).alias("signed_margin_pct"),
            "party_a", "party_b",
            M.turnout_pct(polled, F.col("electors")).alias("turnout_pct"),
            "lineage_kind",
        )

    @cached_property
    def adjacent(self) -> DataFrame:
        """Each contest with the one before it, of its group and kind."""
        w = Window.partitionBy("group_id", "kind").orderBy("year")
        return self.data.contests.select("group_id", "kind", "contest_id", "year", F.lag("contest_id").over(w).alias("prev_contest_id"), F.lag("year").over(w).alias("prev_year"))

    @cached_property
    def quality(self) -> DataFrame:
        return self.result_candidate.groupBy("contest_id", "unit_id").agg(F.min("confidence").alias("confidence"), F.bool_and("reviewed").alias("reviewed"))

    @cached_property
    def quality_of_units(self) -> DataFrame:
        """The quality of a unit's cells by contest, one row a unit: a join by unit alone finds both sides where they lie."""
        entry = F.struct("contest_id", F.struct("confidence", "reviewed"))
        return self.quality.filter("contest_id is not null").groupBy("unit_id").agg(F.map_from_entries(F.collect_list(entry)).alias("by_contest"))

    def _with_quality(self, rows: DataFrame, how: str) -> DataFrame:
        """From raw tables a join by contest and unit: its shuffle parts what would else be the work, and the memory, of one task."""
        if not self.lie_by_unit:
            return rows.join(self.quality, ["contest_id", "unit_id"], how)
        rows = rows.join(self.quality_of_units, "unit_id", how)
        rows = rows.filter(F.map_contains_key("by_contest", F.col("contest_id"))) if how == "inner" else rows
        return rows.withColumn("_q", F.try_element_at("by_contest", F.col("contest_id"))).select("*", "_q.confidence", "_q.reviewed")

    def _gate(self) -> list[Column]:
        return [F.col("confidence"), F.col("reviewed"), F.col("lineage_kind"), F.lit(False)]

    @cached_property
    def swing(self) -> DataFrame:
        w = Window.partitionBy("group_id", "unit_id", "party", "kind").orderBy("year")
        rows = self.party_share.filter(is_not("party", NOTA))
        rows = rows.select("*", *(F.lag(c).over(w).alias(f"prev_{c}") for c in ("share_pct", "votes", "contest_id")))
        if self.strict:  # a party that sat out the contest before has nothing to compare with
            near = self.adjacent.select("contest_id", F.col("prev_contest_id").alias("just_before"))
            # contests are few, and a shuffle by contest would bring all units of one to one task
            rows = rows.join(F.broadcast(near), "contest_id")
            before = F.col("prev_contest_id") == F.col("just_before")
            rows = rows.select(*CELL, "party", "votes", "share_pct", *(F.when(before, F.col(c)).alias(c) for c in ("prev_share_pct", "prev_votes", "prev_contest_id")))
        rows = self._with_quality(rows, "left").join(self.data.units.select("unit_id", "lineage_kind"), "unit_id", "left")
        allowed = M.comparison_allowed(*self._gate())
        return rows.select(
            *CELL, "party", "prev_contest_id", "share_pct", "prev_share_pct",
            M.swing_pct(F.col("share_pct"), F.col("prev_share_pct"), *self._gate()).alias("swing_pct"),
            F.when(allowed, F.col("votes") - F.col("prev_votes")).alias("swing_votes"),
            "confidence", "reviewed", "lineage_kind",
        )

    @cached_property
    def swing_vanished(self) -> DataFrame:
        """Parties that stood in one contest of a unit and not in the next, where the next has results."""
        pairs = self.adjacent.filter("prev_contest_id is not null").select("contest_id", F.col("year").alias("now_year"), "prev_contest_id")
        stood = Window.partitionBy("group_id", "unit_id", "party", "kind").orderBy("year")
        prev = self.party_share.filter(is_not("party", NOTA)).select("group_id", F.col("contest_id").alias("prev_contest_id"), "kind", "unit_id", "party", F.col("votes").alias("prev_votes"), F.col("share_pct").alias("prev_share_pct"), F.lead("contest_id").over(stood).alias("stood_next"))
        rows = prev.join(F.broadcast(pairs), "prev_contest_id").filter(~F.col("stood_next").eqNullSafe(F.col("contest_id")))
        # an inner join with the quality of cells also asks for results of the later contest
        rows = self._with_quality(rows, "inner").join(self.data.units.select("unit_id", "lineage_kind"), "unit_id", "left")
        zero = F.lit(0.0)
        return rows.select(
            "group_id", "contest_id", "kind", F.col("now_year").alias("year"), "unit_id", "party", "prev_contest_id",
            zero.alias("share_pct"), "prev_share_pct",
            M.swing_pct(zero, F.col("prev_share_pct"), *self._gate()).alias("swing_pct"),
            F.when(M.comparison_allowed(*self._gate()), -F.col("prev_votes")).alias("swing_votes"),
        )

    @cached_property
    def swing_all(self) -> DataFrame:
        return self.swing.select(*self.swing_vanished.columns).unionByName(self.swing_vanished)

    @cached_property
    def transfer(self) -> DataFrame:
        """The two kinds of a year side by side: conditional sums instead of a full outer join on null-safe keys."""
        rows = self.party_share.filter(is_not("party", NOTA)) if self.exclude_nota else self.party_share
        pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
        rows = rows.groupBy("group_id", "year", "unit_id", "party").agg(*(pick(k, c).alias(f"{k.lower()}_{c}") for c in ("votes", "share_pct") for k in ("LS", "VS")))
        return rows.withColumns({"delta_votes": F.col("vs_votes") - F.col("ls_votes"), "delta_share_pct": M.transfer_delta(F.col("vs_share_pct"), F.col("ls_share_pct"))})

    @cached_property
    def floating_vote(self) -> DataFrame:
        delta = F.abs(F.coalesce(M.hundredths(F.col("vs_share_pct")), F.lit(0)) - F.coalesce(M.hundredths(F.col("ls_share_pct")), F.lit(0)))
        legs = F.max(F.col("ls_votes").isNotNull().cast("long")) + F.max(F.col("vs_votes").isNotNull().cast("long"))
        rows = self.transfer.groupBy("group_id", "year", "unit_id").agg(F.sum(delta).alias("moved"), legs.alias("poll_types"))
        return rows.select("group_id", "year", "unit_id", M.floating_pct(F.col("moved") / 100.0, F.col("poll_types")).alias("floating_pct"), "poll_types")

    @cached_property
    def volatility(self) -> DataFrame:
        m = F.col("signed_margin_pct")
        return self.wide.filter("kind = 'VS'").groupBy("group_id", "unit_id").agg(F.count(m).alias("years_available"), M.volatility_agg(m).alias("margin_stddev"), M.mean_agg(m).alias("margin_mean"))

    @cached_property
    def roll_windows(self) -> DataFrame:
        """Per contest with a roll: (window_start, window_end], and the full rolls at both ends."""
        w = Window.partitionBy("group_id", "kind").orderBy("year")
        rows = self.data.links.select("group_id", "contest_id", "kind", "year", F.col("day").alias("window_end"), F.lag("day").over(w).alias("window_start"))
        full = self.data.snapshots.select(F.col("day").alias("full_day")).distinct()
        # the latest full roll at either end: rolls are few, one row a day at most
        at = lambda name, end: rows.join(F.broadcast(full), F.col("full_day") <= F.col(end)).groupBy("contest_id").agg(F.max("full_day").alias(name))
        return rows.join(at("end_roll", "window_end"), "contest_id", "left").join(at("start_roll", "window_start"), "contest_id", "left")

    @cached_property
    def new_voter_share(self) -> DataFrame:
        w = self.roll_windows
        units = self.data.units.select("group_id", "unit_id")
        changes = self.data.roll_changes.join(units, "unit_id")
        inside = in_windows(changes, w.select("group_id", "contest_id", "window_start", "window_end"), ["group_id"], "day", "window_start", "window_end")
        n = lambda c: F.sum(c).alias(c)
        inside = inside.groupBy("contest_id", "unit_id").agg(n("additions"), n("deletions"), n("modifications"))
        rolls = self.data.snapshots.select("unit_id", "day", "electors")
        ends = rolls.join(units, "unit_id").join((w.select("group_id", "contest_id", "start_roll", "end_roll")), "group_id").filter("day = end_roll or day = start_roll")
        at = lambda end: F.max(F.when(F.col("day") == F.col(end), F.col("electors")))
        ends = ends.groupBy("contest_id", "unit_id").agg(at("end_roll").alias("electors"), at("start_roll").alias("electors_start"))
        rows = units.join((w.select("group_id", "contest_id", "kind", "year")), "group_id").join(inside, ["contest_id", "unit_id"], "left").join(ends, ["contest_id", "unit_id"], "left")
        a, d = F.col("additions"), F.col("deletions")
        return rows.select("group_id", "contest_id", "unit_id", "additions", "deletions", "modifications", "electors", "electors_start", M.new_voter_pct(a, F.col("electors")).alias("new_voter_pct"), M.net_roll_change_pct(a, d, F.col("electors_start")).alias("net_roll_change_pct"))

    @cached_property
    def priority(self) -> DataFrame:
        base = self.data.contests.filter("is_baseline").select("contest_id")
        rows = self.wide.join(F.broadcast(base), "contest_id", "left_semi")
        rows = rows.join(self.new_voter_share.select("contest_id", "unit_id", "new_voter_pct", "additions"), ["contest_id", "unit_id"], "left")
        rows = rows.join(self.floating_vote.select("group_id", "year", "unit_id", "floating_pct"), ["group_id", "year", "unit_id"], "left")
        rows = rows.join(self.volatility.select("group_id", "unit_id", "margin_stddev", "years_available"), ["group_id", "unit_id"], "left")
        rows = percent_ranks_in(self._shared(rows), "group_id", ["contest_id", "unit_id"], {"margin_pct": "_far", "new_voter_pct": "_new", "floating_pct": "_float", "margin_stddev": "_vol"})
        inputs = [1 - F.col("_far"), F.col("_new"), F.col("_float"), F.col("_vol")]
        used = F.array_compact(F.array(*(F.when(x.isNotNull(), n) for x, n in zip(inputs, ("closeness", "new_voter_pct", "floating_pct", "volatility"), strict=True))))
        rows = rows.withColumns({"priority_score": M.priority_score(*inputs), "weight_used": M.priority_weight(*inputs), "inputs_used": F.array_join(used, ",")})
        rows = ntile_in(rows, "group_id", "unit_id", "priority_score", "priority_quartile")
        return rows.select("group_id", "unit_id", "contest_id", "area_id", "electors", "turnout_pct", "margin_pct", "margin_votes", "signed_margin_pct", "winner_party", "runner_party", "new_voter_pct", "additions", "floating_pct", "margin_stddev", "years_available", "inputs_used", "weight_used", "priority_score", "priority_quartile")

    def _rollup(self, *keys: str) -> DataFrame:
        n = lambda c: F.sum(c).alias(c)
        rows = self.wide.groupBy("group_id", "contest_id", "kind", "year", *keys).agg(F.count(F.lit(1)).alias("booths"), *(n(c) for c in ("electors", "valid_votes", "votes_polled", "nota", *(p.lower() for p in self.parties), "others")), F.count("electors").alias("booths_with_electors"))
        whole = F.col("booths") == F.col("booths_with_electors")
        return rows.withColumn("turnout_pct", F.when(whole, M.turnout_pct(F.col("votes_polled"), F.col("electors"))))

    @cached_property
    def area_rollup(self) -> DataFrame:
        rows, (a, b) = self._rollup("area_id", "block_id"), self.parties[:2]
        return rows.withColumns({f"{p.lower()}_pct": M.share_pct(F.col(p.lower()), F.col("valid_votes")) for p in (a, b)})

    @cached_property
    def group_candidates(self) -> DataFrame:
        return self.result_candidate.groupBy("group_id", "contest_id", "kind", "year", "candidate", "party", "contestant").agg(F.sum("votes").alias("votes"))

    @cached_property
    def group_summary(self) -> DataFrame:
        totals = self._rollup().select("group_id", "contest_id", "kind", "year", "booths", "electors", "valid_votes", "votes_polled", "nota", F.col(self.parties[2].lower()).alias("third_votes"), "turnout_pct")
        real = self.group_candidates.filter(is_not("party", NOTA))
        order = Window.partitionBy("contest_id").orderBy(F.desc("votes"), "candidate")
        real = real.withColumn("place", F.row_number().over(order))
        top = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
        heads = real.groupBy("contest_id").agg(F.count(F.lit(1)).alias("n"), *(top(c, k).alias(f"{w}_{o}") for k, w in ((1, "winner"), (2, "runner")) for c, o in (("contestant", "party"), ("candidate", "candidate"), ("votes", "votes"))))
        rolls = self.new_voter_share.groupBy("contest_id").agg(F.sum("additions").alias("additions"), F.sum("electors").alias("roll"))
        sure = self.data.units.groupBy("group_id").agg(F.count(F.lit(1)).alias("units"), F.sum((F.col("confidence") >= M.CONFIDENT).cast("long")).alias("linked"))
        rows = totals.join(self.data.contests.select("contest_id", "is_baseline", "party_a", "party_b"), "contest_id").join(heads, "contest_id", "left").join(rolls, "contest_id", "left").join(sure, "group_id", "left")
        w, r, n, valid = F.col("winner_votes"), F.col("runner_votes"), F.col("n"), F.col("valid_votes")
        return rows.select(
            "group_id", "contest_id", "kind", "year", "is_baseline", "booths", "electors", "valid_votes", "votes_polled", "nota",
            "winner_party", "winner_candidate", "winner_votes", "runner_party", "runner_candidate", "runner_votes",
            M.margin_votes(w, r, n).alias("margin_votes"), M.margin_pct(w, r, n, valid).alias("margin_pct"),
            M.signed_margin_pct(F.col("winner_party"), w, r, n, valid, F.col("party_a"), F.col("party_b")).alias("signed_margin_pct"),
            "turnout_pct", M.share_pct(F.coalesce("third_votes", F.lit(0)), valid).alias("third_share_pct"),
            "additions", M.new_voter_pct(F.col("additions"), F.col("roll")).alias("new_voter_pct"),
            M.pct(F.col("linked"), F.col("units")).alias("link_coverage_pct"), "units",
        )

    @cached_property
    def joint_segments(self) -> DataFrame:
        """Candidates of contests that span groups, cut by group, with the sum over all groups."""
        rows = self.group_candidates.filter("kind = 'LS'")
        whole = rows.groupBy("year", "contestant").agg(F.sum("votes").alias("total_votes"), F.count(F.lit(1)).alias("segments"))
        rows = rows.groupBy("year", "group_id", "contest_id", "contestant").agg(F.sum("votes").alias("segment_votes")).join(whole, ["year", "contestant"])
        return rows.withColumn("segment_pct", M.pct(F.col("segment_votes"), F.col("total_votes")))


def store(df: DataFrame, path: str, buckets: int = 0, keys: Sequence[str] = ("unit_id",), format: str = "parquet", folders: Sequence[str] = ()) -> DataFrame:
    """df, written to path and read again.

    With buckets, rows that come in as many partitions by keys are stored as they lie, one file each, and read so: steps by these keys, in whatever reads
    them, need no shuffle. A table has buckets, a folder hasn't, so there is a table for as long as it takes to open it.
    """
    spark, writer = df.sparkSession, df.write.mode("overwrite").format(format)
    if folders:
        writer = writer.partitionBy(*folders)
    if not buckets:
        writer.save(path)
        return spark.read.schema(df.schema).format(format).load(path)
    table = f"spark_catalog.default.stored_{uuid.uuid4().hex}"
    try:
        writer.bucketBy(buckets, *keys).option("path", path).saveAsTable(table)
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # not its files, as they are in a place of their own


def refresh(views: Views, path: str, names: Sequence[str] = ORDER) -> dict[str, float]:
    """Write views in dependency order; each next one reads what was written. Returns seconds by view."""
    import time

    took, views.lie_by_unit = {}, views.data.unit_tasks > 0
    for name in (n for n in ORDER if n in names):
        began = time.monotonic()
        views.__dict__[name] = store(views[name], f"{path}/{name}", views.data.unit_tasks if name in BY_UNIT else 0)
        took[name] = time.monotonic() - began
    views.release()
    return took
