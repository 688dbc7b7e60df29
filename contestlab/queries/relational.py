"""Single relational operations, each as one query: predicates, joins, aggregates, windows, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestlab.functions import metrics as M
from contestlab.model import BASELINE
from contestlab.operators.temporal import as_of, in_windows
from contestlab.plans.view_sql import over_views, pct

from .derived import star_views
from .results import where
from .texts import read


def n() -> Column:
    return F.count(F.lit(1))


def roll_changes(spark, sf_dir) -> DataFrame:
    """Each change with the electors of the last full roll at or before its day.

    Rolls are few: the roll of each day is found once, and the changes then join on unit and day.
    """
    d = star_views(spark, sf_dir).data
    days, rolls = d.roll_changes.select("day").distinct(), d.snapshots.select(F.col("day").alias("roll")).distinct()
    of = days.join(F.broadcast(rolls), F.col("roll") <= F.col("day")).groupBy("day").agg(F.max("roll").alias("roll"))
    rows = d.roll_changes.join(of, "day", "left").join(d.units.select("unit_id", "area_id", "block_id"), "unit_id")
    rows = rows.join(d.snapshots.select("unit_id", F.col("day").alias("roll"), "electors"), ["unit_id", "roll"], "left")
    return rows.select("unit_id", "day", "area_id", "block_id", "additions", "deletions", "modifications", "electors", M.pct(F.col("additions"), F.col("electors")).alias("additions_pct"), M.pct(F.col("deletions"), F.col("electors")).alias("deletions_pct"))


def last_rolls(spark, sf_dir) -> DataFrame:
    """roll_changes(), with the last roll of each unit at or before the change's day found by one sorted window."""
    d = star_views(spark, sf_dir).data
    changes = d.roll_changes.join(d.units.select("unit_id", "area_id", "block_id"), "unit_id")
    rows = as_of(changes, d.snapshots.select("unit_id", "day", "electors"), ["unit_id"], "day", ["electors"])
    return rows.select("unit_id", "day", "area_id", "block_id", "additions", "deletions", "modifications", "electors", M.pct(F.col("additions"), F.col("electors")).alias("additions_pct"), M.pct(F.col("deletions"), F.col("electors")).alias("deletions_pct"))


def changes_in_windows(spark, sf_dir) -> DataFrame:
    """Changes summed over windows that overlap: each contest's roll day and the eight days before it."""
    d = star_views(spark, sf_dir).data
    windows = d.links.select("group_id", "contest_id", F.date_sub("day", 8).alias("first"), F.col("day").alias("last"))
    changes = d.roll_changes.join(d.units.select("unit_id", "group_id"), "unit_id")
    inside = in_windows(changes, windows, ["group_id"], "day", "first", "last")
    return inside.groupBy("contest_id", "unit_id").agg(F.sum("additions").alias("additions"), n().alias("days"))


def revisions(spark, sf_dir):
    d = star_views(spark, sf_dir).data
    full = d.snapshots.select("day").distinct().withColumn("is_full", F.lit(True))
    rows = d.roll_changes.groupBy("day").agg(n().alias("units"), F.sum("additions").alias("additions"))
    return rows.join(full, "day", "left").withColumn("is_full", F.coalesce("is_full", F.lit(False)))


def latest_snapshot(spark, sf_dir):
    rows = star_views(spark, sf_dir).data.snapshots.groupBy("unit_id").agg(F.max_by("electors", "day").alias("electors"), F.max("day").alias("day"))
    return rows


def customers(spark, sf_dir):
    return read(spark, sf_dir, "customer")


def orders(spark, sf_dir):
    return read(spark, sf_dir, "orders")


def lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem")


def inner_join(spark: SparkSession, sf_dir: str):
    o = orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderstatus")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    rows = lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("o_orderstatus", "p_type").agg(n().alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


def update_from(spark, sf_dir):
    """Customers below zero take their nation's mean balance, in whole hundredths."""
    mean = customers(spark, sf_dir).groupBy("c_nationkey").agg(F.floor(F.sum(M.hundredths(F.col("c_acctbal"))) / n()).cast("long").alias("mean_h"))
    rows = customers(spark, sf_dir).join(mean, "c_nationkey", "left")
    return rows.select("c_custkey", F.when(F.col("c_acctbal") < 1000, F.coalesce("mean_h", F.lit(0))).otherwise(M.hundredths(F.col("c_acctbal"))).alias("balance_h"))


def dictionary_explode(spark, sf_dir):
    """Each order's priority histogram by customer through a dictionary of several weights a word."""
    h = orders(spark, sf_dir).groupBy("o_custkey", "o_orderpriority").agg(n().alias("n"))
    d = spark.createDataFrame([("1-URGENT", "x", 75), ("1-URGENT", "y", 25), ("5-LOW", "y", 100)], "word string, class string, weight int")
    return h.join(d, F.col("o_orderpriority") == F.col("word")).groupBy("o_custkey", "class").agg(F.sum(F.col("n") * F.col("weight")).alias("hundredths"))


def coalesce_key(spark, sf_dir):
    c = customers(spark, sf_dir).select(F.col("c_custkey"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("own"))
    names = read(spark, sf_dir, "nation").select(F.col("n_nationkey"), "n_name")
    return c.join(names, F.coalesce("own", (F.col("c_custkey") % 25).cast("int")) == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


def adjacent_contests(spark, sf_dir):
    return star_views(spark, sf_dir).adjacent.select("group_id", "kind", "contest_id", "prev_contest_id").filter("prev_contest_id is not null")


def keys_only(spark, sf_dir, how: str):
    return customers(spark, sf_dir).join(orders(spark, sf_dir).filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", how).select("c_custkey", "c_mktsegment")


def pivot_sums(spark, sf_dir):
    sums = [F.sum(F.when(F.col("l_returnflag") == x, F.col("l_quantity"))).cast("long").alias(x.lower()) for x in "ANR"]
    return lines(spark, sf_dir).groupBy("l_linestatus").agg(*sums)


def null_gate(spark, sf_dir):
    rows = star_views(spark, sf_dir).data.units.groupBy("area_id").agg(n().alias("units"), F.count("electors").alias("known"), F.sum("electors").alias("electors"))
    return rows.select("area_id", "units", F.when(F.col("units") == F.col("known"), F.col("electors")).alias("electors"))


def rolls_by_lag(spark, sf_dir):
    d = star_views(spark, sf_dir).data
    return d.links.select("contest_id", "day", F.lag("day").over(Window.partitionBy("group_id", "kind").orderBy("year")).alias("before"))


def correlation(spark, sf_dir):
    """Pearson's r and the line of two whole numbers by brand, from exact sums."""
    x, y = F.col("p_size").cast("long"), F.floor("p_retailprice").cast("long")
    s = read(spark, sf_dir, "part").groupBy("p_brand").agg(n().alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy")).filter("n >= 4")
    sxy, sxx, syy = (F.col("n") * F.col(a) - F.col(b) * F.col(c) for a, b, c in (("xy", "x", "y"), ("xx", "x", "x"), ("yy", "y", "y")))
    r = F.coalesce(F.try_divide(sxy.cast("double"), F.sqrt(sxx.cast("double") * syy.cast("double"))), F.lit(0.0))
    return s.select("p_brand", "n", F.round(r, 6).alias("r"), F.round(F.try_divide(sxy.cast("double"), sxx.cast("double")), 6).alias("slope"))


QUERIES = {
    "q_roll_changes": roll_changes,
    "join_asof_lateral": last_rolls,
    "join_range_window": changes_in_windows,
    "q_revisions": revisions,
    "join_latest_lateral": latest_snapshot,
    "join_inner_equi": inner_join,
    "join_update_from": update_from,
    "join_dict_explode": dictionary_explode,
    "join_coalesce_key": coalesce_key,
    "join_theta_self_adjacent": adjacent_contests,
    "join_semi": lambda spark, sf_dir: keys_only(spark, sf_dir, "left_semi"),
    "join_anti_orphan": lambda spark, sf_dir: keys_only(spark, sf_dir, "left_anti"),
    "agg_filter_pivot": pivot_sums,
    "agg_count_nonnull_gate": null_gate,
    "agg_count_distinct": lambda spark, sf_dir: lines(spark, sf_dir).groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers")),
    "agg_string_ordered": lambda spark, sf_dir: read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations")),
    "agg_having": lambda spark, sf_dir: orders(spark, sf_dir).groupBy("o_custkey").agg(n().alias("n")).filter("n >= 15"),
    "agg_corr": correlation,
    "agg_unnest_group": lambda spark, sf_dir: read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(n().alias("n")),
    "win_lag_date": rolls_by_lag,
    "win_row_number": lambda spark, sf_dir: star_views(spark, sf_dir).ranked.select("contest_id", "unit_id", "contestant", "votes", "place"),
    "win_distinct_on": lambda spark, sf_dir: orders(spark, sf_dir).groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("last_order")),
    "win_count_partition": lambda spark, sf_dir: read(spark, sf_dir, "supplier").select("s_suppkey", F.count("s_suppkey").over(Window.partitionBy("s_nationkey")).alias("of_nation")),
    "filt_dynamic": lambda spark, sf_dir: where(star_views(spark, sf_dir).wide, kind="VS", year=BASELINE[1], block_id=[1, 101, 201], area_id=None).select("contest_id", "unit_id"),
    "filt_ilike": lambda spark, sf_dir: read(spark, sf_dir, "part").filter(F.col("p_name").ilike("%RED%")).select("p_partkey"),
    "filt_like_prefix": lambda spark, sf_dir: customers(spark, sf_dir).filter(F.startswith("c_mktsegment", F.lit("FUR"))).select("c_custkey"),
    "filt_regex_pg": lambda spark, sf_dir: read(spark, sf_dir, "pages").filter(F.col("url").rlike("[?&]page=[0-9]+")).select("page_id"),
    "filt_nullsafe": lambda spark, sf_dir: star_views(spark, sf_dir).data.units.filter(~F.col("lineage_kind").eqNullSafe(F.lit("split"))).select("unit_id"),
    "filt_date_window": lambda spark, sf_dir: orders(spark, sf_dir).filter((F.col("o_orderdate") >= "1997-01-01") & (F.col("o_orderdate") < "1997-02-01")).select("o_orderkey"),
    "sort_multi_nulls": lambda spark, sf_dir: star_views(spark, sf_dir).data.units.orderBy(F.desc_nulls_last("electors"), F.asc_nulls_first("rejected"), "unit_id").limit(100).select("unit_id", "electors", "rejected"),
    "topk": lambda spark, sf_dir: orders(spark, sf_dir).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey"),
}
SQL = {
    "q_roll_changes": over_views(f"""SELECT c.unit_id, c.day, u.area_id, u.block_id, additions, deletions, modifications, CAST(s.electors AS BIGINT) AS electors, {pct("additions", "s.electors")} AS additions_pct, {pct("deletions", "s.electors")} AS deletions_pct
  FROM roll_changes c JOIN units u ON u.unit_id = c.unit_id ASOF LEFT JOIN snapshots s ON s.unit_id = c.unit_id AND s.day <= c.day"""),
    "q_revisions": over_views("SELECT day, count(*) AS units, CAST(sum(additions) AS BIGINT) AS additions, EXISTS (FROM snapshots s WHERE s.day = c.day) AS is_full FROM roll_changes c GROUP BY 1"),
    "join_latest_lateral": over_views("SELECT DISTINCT ON (unit_id) unit_id, CAST(electors AS BIGINT) AS electors, day FROM snapshots ORDER BY unit_id, day DESC"),
    "join_inner_equi": "SELECT o_orderstatus, p_type, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "join_update_from": """WITH h AS (SELECT *, CAST(sign(c_acctbal) * floor(abs(c_acctbal) * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS h FROM customer)
SELECT c_custkey, CASE WHEN c_acctbal < 1000 THEN CAST(floor(sum(h) OVER (PARTITION BY c_nationkey) / count(*) OVER (PARTITION BY c_nationkey)) AS BIGINT) ELSE h END AS balance_h FROM h""",
    "join_dict_explode": "SELECT o_custkey, class, CAST(sum(weight) AS BIGINT) AS hundredths FROM orders JOIN (VALUES ('1-URGENT', 'x', 75), ('1-URGENT', 'y', 25), ('5-LOW', 'y', 100)) d(word, class, weight) ON o_orderpriority = word GROUP BY 1, 2",
    "join_coalesce_key": "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 3 != 0 THEN c_nationkey ELSE c_custkey % 25 END",
    "join_theta_self_adjacent": over_views("""SELECT a.group_id, a.kind, b.contest_id, a.contest_id AS prev_contest_id FROM contests a JOIN contests b ON a.group_id = b.group_id AND a.kind = b.kind AND b.year > a.year
  WHERE NOT EXISTS (FROM contests m WHERE m.group_id = a.group_id AND m.kind = a.kind AND m.year > a.year AND m.year < b.year)"""),
    "join_semi": "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "join_anti_orphan": "SELECT c_custkey, c_mktsegment FROM customer LEFT JOIN (FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey WHERE o_orderkey IS NULL",
    "agg_filter_pivot": "SELECT l_linestatus, " + ", ".join(f"CAST(sum(l_quantity) FILTER (l_returnflag = '{x}') AS BIGINT) AS {x.lower()}" for x in "ANR") + " FROM lineitem GROUP BY 1",
    "agg_count_nonnull_gate": over_views("SELECT area_id, count(*) AS units, CASE WHEN count(*) = count(electors) THEN CAST(sum(electors) AS BIGINT) END AS electors FROM units GROUP BY 1"),
    "agg_count_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
    "agg_string_ordered": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation GROUP BY 1",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING n >= 15",
    "agg_corr": """WITH s AS (SELECT p_brand, count(*) AS n, CAST(sum(x) AS BIGINT) AS x, CAST(sum(y) AS BIGINT) AS y, CAST(sum(x * y) AS BIGINT) AS xy, CAST(sum(x * x) AS BIGINT) AS xx, CAST(sum(y * y) AS BIGINT) AS yy FROM (SELECT p_brand, CAST(p_size AS BIGINT) AS x, CAST(floor(p_retailprice) AS BIGINT) AS y FROM part) GROUP BY 1)
SELECT p_brand, n, round(coalesce(CAST(n * xy - x * y AS DOUBLE) / nullif(sqrt(CAST(n * xx - x * x AS DOUBLE) * CAST(n * yy - y * y AS DOUBLE)), 0), 0), 6) AS r, round(CAST(n * xy - x * y AS DOUBLE) / nullif(CAST(n * xx - x * x AS DOUBLE), 0), 6) AS slope FROM s WHERE n >= 4""",
    "agg_unnest_group": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1",
    "win_lag_date": over_views("SELECT contest_id, day, lag(day) OVER (PARTITION BY group_id, kind ORDER BY year) AS before FROM links"),
    "win_row_number": over_views("SELECT contest_id, unit_id, contestant, votes, CAST(CASE WHEN party != 'NOTA' THEN row_number() OVER (PARTITION BY contest_id, unit_id ORDER BY party != 'NOTA' DESC, votes DESC, contestant) END AS INT) AS place FROM result_candidate"),
    "win_distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey AS last_order FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC",
    "win_count_partition": "SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS of_nation FROM supplier",
    "filt_dynamic": over_views(f"SELECT contest_id, unit_id FROM wide WHERE kind = 'VS' AND year = {BASELINE[1]} AND block_id IN (1, 101, 201)"),
    "filt_ilike": "SELECT p_partkey FROM part WHERE p_name ILIKE '%RED%'",
    "filt_like_prefix": "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'FUR%'",
    "filt_regex_pg": "SELECT page_id FROM pages WHERE regexp_matches(url, '[?&]page=[0-9]+')",
    "filt_nullsafe": over_views("SELECT unit_id FROM units WHERE lineage_kind IS DISTINCT FROM 'split'"),
    "filt_date_window": "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1997-02-01'",
    "sort_multi_nulls": over_views("SELECT unit_id, electors, rejected FROM units ORDER BY electors DESC NULLS LAST, rejected NULLS FIRST, unit_id LIMIT 100"),
    "topk": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
}
SQL["join_asof_lateral"] = SQL["q_roll_changes"]
SQL["join_range_window"] = over_views("SELECT contest_id, c.unit_id, CAST(sum(additions) AS BIGINT) AS additions, count(*) AS days FROM roll_changes c JOIN units u USING (unit_id) JOIN links l ON l.group_id = u.group_id AND c.day > l.day - 8 AND c.day <= l.day GROUP BY 1, 2")
