"""The base tables of contests, and an adapter that reads them from the star-schema test data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parties with a column of their own in wide rows; all others are summed. Any list will do.
PARTIES = ("ECONOMY", "LARGE", "MEDIUM", "STANDARD")
PAIR = ("ECONOMY", "LARGE")
BASELINE = ("VS", 2000)
FIRST_DAY = "2024-01-01"
#: Lines that one task of a unit table may get; up to so many in all, Spark deals them out by itself.
TASK_LINES, FEW_LINES = 250_000, 8_000_000


@dataclass
class ContestData:
    """Base tables.

    units: unit_id, group_id, area_id, block_id, electors, rejected, confidence, reviewed, lineage_kind
    votes: group_id, contest_id, kind, year, unit_id, candidate, party, contestant, votes, confidence, reviewed
    contests: group_id, contest_id, kind, year, is_baseline, party_a, party_b
    roll_changes: unit_id, day, additions, deletions, modifications
    snapshots: unit_id, day, electors (of full rolls)
    links: contest_id, group_id, kind, year, day (the roll that a contest was held on)
    unit_tasks: how many partitions the votes are dealt to by unit_id; 0 if Spark deals them out by itself
    """

    units: DataFrame
    votes: DataFrame
    contests: DataFrame
    roll_changes: DataFrame
    snapshots: DataFrame
    links: DataFrame
    unit_tasks: int = 0

    def scope(self, group_id: int | None = None, block_id: int | None = None) -> ContestData:
        """Only what a tenant, or a role bound to one block, may see. Filters reach the scans."""
        units, votes, contests, links = self.units, self.votes, self.contests, self.links
        if group_id is not None:
            units, votes, contests, links = (x.filter(F.col("group_id") == group_id) for x in (units, votes, contests, links))
        if block_id is not None:
            units = units.filter(F.col("block_id") == block_id)
        if group_id is not None or block_id is not None:
            own = units.select("unit_id")
            return ContestData(units, votes.join(own, "unit_id", "left_semi"), contests, self.roll_changes.join(own, "unit_id", "left_semi"), self.snapshots.join(own, "unit_id", "left_semi"), links)
        return self


def contest_id(group, year, kind):
    return (group * 100000 + year * 10 + (kind == "LS").cast("int")).cast("long")


def tasks_by_unit(spark: SparkSession, n: int, few: int = FEW_LINES) -> int:
    """How many partitions n lines are dealt to by unit; 0 if they are so few that Spark does it by itself."""
    # fewer than the session's number would be dealt out anew by the next join
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_LINES)) if n > few else 0


def dealt_by_unit(lines: DataFrame, n: int, few: int = FEW_LINES) -> DataFrame:
    """n lines (unit_id and others), by unit in as many partitions as keep a task small.

    All steps on a unit's cells follow in the same tasks, each with memory of its own, so the number of partitions grows with
    the lines, and adaptive execution must not merge them to the few that would do for one step.
    """
    parts = tasks_by_unit(lines.sparkSession, n, few)
    return lines.repartition(parts, "unit_id") if parts else lines


def from_star(spark: SparkSession, sf_dir: str, few: int = FEW_LINES) -> ContestData:
    """Customers are units, nations areas, regions groups; part types are parties and quantities votes."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    k = F.col("c_custkey")
    units = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("unit_id"),
        F.col("n_regionkey").alias("group_id"),
        F.col("n_nationkey").alias("area_id"),
        (F.col("n_regionkey") * 100 + F.col("n_nationkey") % 3).alias("block_id"),
        F.when(k % 7 != 0, 200 + k % 300).alias("electors"),
        F.when(k % 11 != 0, k % 5).alias("rejected"),
        (((k * 37) % 40 + 60) / F.lit(100.0)).alias("confidence"),
        (k % 13 == 0).alias("reviewed"),
        F.when(k % 61 == 7, "split").alias("lineage_kind"),
    )
    party = F.when(F.col("p_type") == "SMALL", "NOTA").when(F.col("p_type") == "PROMO", "IND").otherwise(F.col("p_type"))
    kind, year = F.when(F.col("l_linestatus") == "O", "VS").otherwise("LS"), F.year("l_shipdate")
    lines = read("lineitem").join(read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(read("part").select("p_partkey", party.alias("party"), "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    candidate = F.when(F.col("party") == "IND", F.col("p_brand")).otherwise(F.col("party"))
    lines = lines.select(F.col("o_custkey").alias("unit_id"), kind.alias("kind"), year.alias("year"), "party", candidate.alias("candidate"), "l_quantity")
    n_lines = read("lineitem").count()
    cells = dealt_by_unit(lines, n_lines, few).groupBy("unit_id", "kind", "year", "party", "candidate").agg(F.sum("l_quantity").cast("long").alias("votes"))
    votes = cells.join(units.select("unit_id", "group_id", "confidence", "reviewed"), "unit_id").select(
        "group_id",
        contest_id(F.col("group_id"), F.col("year"), F.col("kind")).alias("contest_id"),
        "kind",
        "year",
        "unit_id",
        "candidate",
        "party",
        F.when(F.col("party") == "IND", F.concat(F.lit("IND:"), "candidate")).otherwise(F.col("party")).alias("contestant"),
        "votes",
        "confidence",
        "reviewed",
    )
    years = read("lineitem").select(kind.alias("kind"), year.alias("year")).distinct()
    groups = read("region").select(F.col("r_regionkey").alias("group_id"))
    contests = groups.crossJoin(years).select(
        "group_id",
        contest_id(F.col("group_id"), F.col("year"), F.col("kind")).alias("contest_id"),
        "kind",
        "year",
        ((F.col("kind") == BASELINE[0]) & (F.col("year") == BASELINE[1])).alias("is_baseline"),
        F.lit(PAIR[0]).alias("party_a"),
        F.lit(PAIR[1]).alias("party_b"),
    )
    n = lambda t: F.sum((F.col("event_type") == t).cast("long"))
    changes = read("events").groupBy(F.col("user_id").alias("unit_id"), F.to_date("ts").alias("day")).agg(n("signup").alias("additions"), n("error").alias("deletions"), n("click").alias("modifications"))
    days = spark.range(30).select(F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("id").cast("int")).alias("day"), F.col("id"))
    rolls = days.filter(F.col("id") % 3 == 1)
    snapshots = units.filter("electors is not null").crossJoin(F.broadcast(rolls)).select("unit_id", "day", (F.col("electors") + F.col("id")).alias("electors"))
    links = contests.filter("kind = 'VS'").select("contest_id", "group_id", "kind", "year", F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("year") - 1995) * 4).alias("day"))
    return ContestData(units, votes, contests, changes, snapshots, links, tasks_by_unit(spark, n_lines, few))


#: The same tables as DuckDB CTEs.
STAR_SQL = f"""
units AS (SELECT c_custkey AS unit_id, n_regionkey AS group_id, n_nationkey AS area_id, n_regionkey * 100 + n_nationkey % 3 AS block_id,
  CASE WHEN c_custkey % 7 != 0 THEN 200 + c_custkey % 300 END AS electors, CASE WHEN c_custkey % 11 != 0 THEN c_custkey % 5 END AS rejected,
  ((c_custkey * 37) % 40 + 60) / 100.0::DOUBLE AS confidence, c_custkey % 13 = 0 AS reviewed, CASE WHEN c_custkey % 61 = 7 THEN 'split' END AS lineage_kind
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
cells AS (SELECT o_custkey AS unit_id, CASE WHEN l_linestatus = 'O' THEN 'VS' ELSE 'LS' END AS kind, CAST(year(l_shipdate) AS INT) AS year,
  CASE p_type WHEN 'SMALL' THEN 'NOTA' WHEN 'PROMO' THEN 'IND' ELSE p_type END AS party,
  CASE p_type WHEN 'SMALL' THEN 'NOTA' WHEN 'PROMO' THEN p_brand ELSE p_type END AS candidate, CAST(sum(l_quantity) AS BIGINT) AS votes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
mv_result_booth_candidate AS (SELECT group_id, CAST(group_id * 100000 + year * 10 + CAST(kind = 'LS' AS INT) AS BIGINT) AS contest_id, kind, year, unit_id, candidate, party,
  CASE WHEN party = 'IND' THEN 'IND:' || candidate ELSE party END AS contestant, votes, confidence, reviewed FROM cells JOIN units USING (unit_id)),
contests AS (SELECT r_regionkey AS group_id, CAST(r_regionkey * 100000 + year * 10 + CAST(kind = 'LS' AS INT) AS BIGINT) AS contest_id, kind, year, kind = '{BASELINE[0]}' AND year = {BASELINE[1]} AS is_baseline,
  '{PAIR[0]}' AS party_a, '{PAIR[1]}' AS party_b FROM region, (SELECT DISTINCT CASE WHEN l_linestatus = 'O' THEN 'VS' ELSE 'LS' END AS kind, CAST(year(l_shipdate) AS INT) AS year FROM lineitem)),
roll_changes AS (SELECT user_id AS unit_id, CAST(ts AS DATE) AS day, CAST(count(*) FILTER (event_type = 'signup') AS BIGINT) AS additions, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS deletions, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS modifications FROM events GROUP BY 1, 2),
snapshots AS (SELECT unit_id, CAST(DATE '{FIRST_DAY}' + CAST(i AS INT) AS DATE) AS day, electors + i AS electors FROM units, range(30) t(i) WHERE i % 3 = 1 AND electors IS NOT NULL),
links AS (SELECT contest_id, group_id, kind, year, CAST(DATE '{FIRST_DAY}' + (year - 1995) * 4 AS DATE) AS day FROM contests WHERE kind = 'VS')"""
