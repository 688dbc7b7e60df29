"""What comes in and goes out: sheets, joint documents, rolls, names, guarded SQL, tables and streams, over the star-schema data."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlab.functions import text as T
from contestlab.operators import dedupe as D
from contestlab.operators import guard as G
from contestlab.operators import match as X
from contestlab.plans.view_sql import over_views
from contestlab.plans.views import ORDER, refresh
from contestlab.shared import scratch, written
from contestlab.sources import sheets as S
from contestlab.sources import tables as B
from contestlab.sources.stored import StoredTable
from contestlab.streaming import jobs as J
from contestlab.streaming import state as W

from .derived import star_views
from .models import SEQUENTIAL
from .texts import read

SHEET, PAGES, ROLL = 900, 40, 20


def _path(spark: SparkSession, name: str) -> str:
    return f"{D.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _sheets(spark, sf_dir) -> DataFrame:
    """Parts as sheets of 900 stations: some rows are left out, some printed twice, some have a wrong total."""
    n = F.col("p_partkey")
    text = lambda c: c.cast("string")
    a, b, c, nota = F.col("p_size"), n % 7, n % 3, F.col("p_size") % 4
    total = a + b + c + nota + F.when(n % 101 == 0, 1).otherwise(0)
    cells = F.array(text(n % SHEET + 1), text(a), text(b), text(c), text(total), text(nota))
    rows = read(spark, sf_dir, "part").filter(n % 50 != 7).select(F.floor(n / SHEET).alias("doc"), F.explode(F.sequence(F.lit(1), F.when(n % 333 == 5, 2).otherwise(1))).alias("again"), n.alias("n"), cells.alias("cells"))
    # one sheet's rows
    table = rows.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "again", "cells"))), lambda r: r["cells"]).alias("rows"))
    head = F.array(*map(F.lit, ("Serial No of Polling Station", "First", "Second", "Third", "Total of Valid Votes", "NOTA")))
    return table.select("doc", F.lit(1).alias("page_no"), F.lit("").alias("text"), F.array(F.concat(F.array(head), "rows")).alias("tables"))


def form20_parse(spark, sf_dir):
    return S.sheet_votes(S.sheet_rows(_sheets(spark, sf_dir)))


def form20_validate(spark, sf_dir):
    return S.sheet_errors(S.sheet_rows(_sheets(spark, sf_dir)))


def ls_segment(spark, sf_dir):
    """Parts as pages of documents of 40 pages, some with a section's header."""
    n = F.col("p_partkey")
    head = F.concat(F.lit("Assembly Constituency No. "), F.col("p_size").cast("string"), F.lit(" - "), "p_type", F.lit("\nmore"))
    pages = read(spark, sf_dir, "part").select(F.floor(n / PAGES).alias("doc"), (n % PAGES).alias("page_no"), F.when(n % 5 == 3, head).otherwise("nothing here").alias("text"))
    return S.segments(pages).select("doc", "page_no", "segment", "name", F.col("section").cast("long").alias("section"))


def roll_scan(spark, sf_dir):
    """Customers as rolls of 20 entries."""
    n = F.col("c_custkey")
    line = F.concat(F.lit("ABC"), F.lpad((n % 10_000_000).cast("string"), 7, "0"), F.lit(" Name: Asha "), F.initcap("c_mktsegment"), F.lit(" Age: "), (F.lit(18) + n % 60).cast("string"), F.lit(" Gender: "), F.element_at(F.array(F.lit("M"), F.lit("F"), F.lit("F"), F.lit("O")), (n % 4 + 1).cast("int")))
    rolls = read(spark, sf_dir, "customer").groupBy(F.floor(n / ROLL).alias("doc")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    text = F.concat(F.lit("Polling Station No: "), (F.col("doc") % 999).cast("string"), F.lit("\nPart No: 7\n"), F.array_join("lines", "\n"))
    counts = S.roll_counts(rolls.select("doc", text.alias("text")))
    return counts.withColumns({"names": F.size("surnames"), "builders": F.coalesce(F.try_element_at("surnames", F.lit("Building")), F.lit(0)).cast("long")}).drop("surnames")


_HEADERS = ("NOTA", "Asha Devi (XY)", "Ravi Kumar", "Total Stranger", "Someone (CD)", "Unknown Person (Independent)")


def resolve_column(spark, sf_dir):
    """Six header cells for each nation's contest."""
    contests = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("contest_id"))
    headers = contests.select("contest_id", F.posexplode(F.array(*map(F.lit, _HEADERS))).alias("column", "header"))
    people = spark.createDataFrame([(1, "Asha Devi", "XY"), (2, "Ravi Kumar", "AB"), (3, "Meena Hansda", "CD"), (4, "Sunil Mehta", "CD")], "candidate_id int, name string, party string")
    aliases = spark.createDataFrame([("xy", "XY"), ("A.B.", "AB"), ("cd", "CD")], "alias string, party string")
    return X.resolve_columns(headers, contests.crossJoin(people), aliases).select("contest_id", "column", "method", "candidate_id", "party")


def top3_candidates(spark, sf_dir):
    """The three closest names of parts of one size."""
    part = read(spark, sf_dir, "part")
    headers = part.filter("p_partkey % 9 = 0").select(F.col("p_size").alias("contest_id"), F.col("p_partkey").alias("column"), F.col("p_name").alias("header"))
    return X.closest_candidates(headers, part.filter("p_partkey % 9 = 1").select(F.col("p_size").alias("contest_id"), F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("name")))


def _places(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    names = part.select(F.concat("p_type", F.lit("-"), "p_brand").alias("name"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 3).alias("block_id"))
    known = part.filter("p_brand like '%1%'").select(F.lower(F.concat("p_type", F.lit(" "), "p_brand")).alias("alias"), F.length("p_type").alias("area_id"))
    return names, known


def area_resolve(spark, sf_dir):
    names, known = _places(spark, sf_dir)
    return X.resolve_areas(names.select("name").distinct(), known)


def area_create(spark, sf_dir):
    return X.new_areas(*_places(spark, sf_dir))


_GUARDED = "SELECT p_brand, count(*) AS n, max(p_size) AS most FROM part GROUP BY p_brand"


#: Statements, and the SQL of how many rows each gives; None: it is turned away.
_STATEMENTS = (
    (_GUARDED, f"(SELECT count(*) FROM ({_GUARDED}))"),
    ("SELECT * FROM part", "least(500, (SELECT count(*) FROM part))"),
    ("SELECT p_name FROM part WHERE p_size > 40 LIMIT 10", "least(10, (SELECT count(*) FROM part WHERE p_size > 40))"),
    ("WITH supplier AS (SELECT p_partkey FROM part WHERE p_size = 1) SELECT * FROM supplier", "least(500, (SELECT count(*) FROM part WHERE p_size = 1))"),
    ("SELECT p_size FROM part UNION SELECT 1", "least(500, (SELECT count(*) FROM (SELECT p_size FROM part UNION SELECT 1)))"),
    ("SELECT * FROM supplier", None),
    ("WITH supplier AS (SELECT * FROM supplier) SELECT * FROM supplier", None),
    ("SELECT u.* FROM (WITH supplier AS (SELECT 1 AS y) SELECT * FROM supplier) t JOIN supplier u ON true", None),
    ("SELECT * FROM IDENTIFIER('supplier')", None),
    ("SELECT (SELECT max(s_suppkey) FROM supplier) FROM part", None),
    ("SELECT * FROM part; DROP TABLE part", None),
    ("INSERT INTO part SELECT * FROM part", None),
    ("SELECT java_method('java.lang.System', 'nanoTime')", None),
    ("SELECT current_user FROM part", None),
    ("SELECT * FROM range(10)", None),
    ("SELECT p_nothing FROM part", None),
)


def guard_sql(spark, sf_dir):
    """One statement's rows. It ends in time at any size or not at all; the limit of time is the feature."""
    return G.run(spark, _GUARDED, {"part": read(spark, sf_dir, "part")}, seconds=600)


def guard_sql_verdicts(spark, sf_dir):
    """What becomes of each statement, where only part is allowed though supplier is a view of the caller's session too."""
    own = spark.newSession()
    own.read.parquet(f"{sf_dir}/supplier.parquet").createOrReplaceTempView("supplier")
    tables, found = {"part": read(own, sf_dir, "part")}, []
    for i, (sql, _) in enumerate(_STATEMENTS):
        try:
            ran = G.analysed(own, sql, tables).agg(F.count(F.lit(1)).alias("rows")).first().rows
            found.append((i, "accepted", ran))
        except G.Rejected:
            found.append((i, "rejected", None))
    return spark.createDataFrame(found, "statement int, verdict string, rows long")


_PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def sink_csv(spark, sf_dir):
    """Parts written as CSV and read again by their types: the sink and the scan of the format."""
    path = _path(spark, "csv")
    B.write_csv(read(spark, sf_dir, "part"), path)
    return B.read_csv(spark, path, _PART)


def _merge(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    stored = rows.filter("p_partkey % 3 != 0")
    return stored, rows.filter("p_partkey % 2 = 0").withColumn("p_size", F.col("p_size") + 100)


def _stored(spark, rows: DataFrame, keys: list[str]) -> StoredTable:
    return StoredTable.create(rows, _path(spark, "merged"), keys, buckets=16)


def sink_upsert(spark, sf_dir):
    """A stored table, merged into and read back."""
    stored, changes = _merge(spark, sf_dir)
    table = _stored(spark, stored, ["p_partkey"])
    table.upsert(changes)
    return table.read()


def sink_upsert_guarded(spark, sf_dir):
    stored, changes = _merge(spark, sf_dir)
    table = _stored(spark, stored, ["p_partkey"])
    table.upsert(changes, F.col("p_size") < 25)
    return table.read()


def sink_delete_insert(spark, sf_dir):
    """All rows of a size that changes have are replaced in the stored table."""
    stored, changes = _merge(spark, sf_dir)
    table = _stored(spark, stored, ["p_size"])
    table.replace(changes.withColumn("p_size", F.col("p_size") - 100).filter("p_size < 10"))
    return table.read()


def sink_copy(spark, sf_dir):
    """A table written in two loads."""
    path, part = _path(spark, "copy"), read(spark, sf_dir, "part")
    B.store(part.filter("p_size < 20"), path)
    B.append(part.filter("p_size >= 20"), path)
    return spark.read.schema(part.schema).parquet(path)


def sink_geojson(spark, sf_dir):
    path = _path(spark, "geo")
    places = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.lit(85.0) + F.col("c_custkey") % 8 / 8.0).alias("lon"), F.when(F.col("c_custkey") % 5 != 0, 24.5).alias("lat"))
    B.write_geojson(places, path)
    kind = "struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:struct<c_custkey:bigint,c_mktsegment:string>>"
    f = spark.read.text(path).select(F.from_json("value", kind).alias("f"))
    return f.select("f.properties.c_custkey", "f.properties.c_mktsegment", F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))


def refresh_mv(spark, sf_dir):
    """All views stored, each from those before it, and the rows that each has then."""
    path = _path(spark, "views")
    refresh(star_views(spark, sf_dir), path)
    counts = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("view")) for name in ORDER]
    rows = counts[0]
    for c in counts[1:]:
        rows = rows.unionByName(c)
    return rows.groupBy("view").agg(F.count(F.lit(1)).alias("rows"))


def _stream(spark, rows: DataFrame, name: str) -> DataFrame:
    """rows stored and read as a stream of files."""
    path = _path(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)


def _taken_in(spark, df: DataFrame, keys: list[str], order: str, mode: str = "update") -> DataFrame:
    """What a run over all that is there leaves: the newest row of each key."""
    path = _path(spark, "taken")
    J.merge_into(df, path, _path(spark, "progress"), mode).awaitTermination()
    return J.latest(spark, path, keys, order)


def _events(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


def scan_feed(spark, sf_dir):
    """Pages as a feed of JSON lines, some without a url, taken in as they are."""
    path, out = _path(spark, "feed"), _path(spark, "items")
    url = F.when(F.col("page_id") % 10 != 3, F.col("url"))
    read(spark, sf_dir, "pages").select(url.alias("url"), F.concat(F.lit("Page "), "page_id").alias("title"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("published")).write.json(path)
    J.read_feed(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", _path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(J.FEED + ", url_hash string").parquet(out).select("url_hash", "title", "published")


def stream_dedupe(spark, sf_dir):
    """Pages as a feed, two items of each, by the hash of their url."""
    pages = read(spark, sf_dir, "pages").select(F.explode(F.array("url", F.concat("url", F.lit("#again")))).alias("url"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("published"))
    items = _stream(spark, pages, "feed").withColumn("url_hash", T.url_hash(F.col("url")))
    return _taken_in(spark, J.once_each(items).select("url_hash", F.lit(1).alias("n")), ["url_hash"], "n", "append").select("url_hash")


def stream_dedupe_titles(spark, sf_dir):
    """Documents as titles, one a minute: those that no earlier one that stays is near to."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.simhash(T.fold(F.col("text"))).alias("simhash"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60).alias("seen"))
    kept = _path(spark, "kept")
    with scratch():
        rows = written(rows, "hashes")  # hashed once, by all tasks; what follows reads three numbers a row
        # in three arrivals by their ids
        rows = rows.crossJoin(F.broadcast(rows.agg((F.max("id") + 1).alias("all")))).withColumn("part", F.floor(F.col("id") * 3 / F.col("all"))).drop("all")
        stream = _arrivals(spark, rows, "part", 3, "titles")
    W.keep_new_titles(stream, kept, _path(spark, "progress"), memory=timedelta(days=36_500)).awaitTermination()
    return spark.read.parquet(kept).select("id", "simhash")


def stream_tumbling_week(spark, sf_dir):
    return _taken_in(spark, J.counts_by_week(_stream(spark, _events(spark, sf_dir), "events"), "ts", "event_type", late="400 days"), ["week", "event_type"], "n")


def sched_jobs(spark, sf_dir):
    """A job that takes in all that is there and stops: counts by day."""
    return _taken_in(spark, J.counts_by_day(_stream(spark, _events(spark, sf_dir), "events"), "ts", "event_type", late="400 days"), ["day", "event_type"], "n")


def stream_budget(spark, sf_dir):
    calls = _events(spark, sf_dir).select("user_id", "ts", (F.col("event_id") % 50 + 1).alias("tokens"))
    return _taken_in(spark, J.running_budget(_stream(spark, calls, "calls"), 60, late="400 days"), ["user_id", "day"], "used")


def _arrivals(spark, rows: DataFrame, number: str, n: int, name: str) -> DataFrame:
    """rows as they come in, read as a stream: one file for each arrival, numbered 0 to n - 1, which is one micro-batch; files are taken in the order of writing."""
    path = _path(spark, name)
    for k in range(n):
        rows.filter(F.col(number) == k).drop(number).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop(number).schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_budget_calls(spark, sf_dir):
    """Each call as it arrives, a week's at a time: what its user has used of the day, and the decision."""
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / 7)
    calls = _events(spark, sf_dir).select("user_id", F.col("event_id").alias("call_id"), "ts", (F.col("event_id") % 50 + 1).alias("tokens"), week.alias("week"))
    stream, out = _arrivals(spark, calls, "week", 5, "calls"), _path(spark, "decided")
    with W.rocks(spark):
        query = W.decided_calls(stream, 60).writeStream.format("parquet").option("path", out).option("checkpointLocation", _path(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("user_id long, call_id long, day date, used long, state string").parquet(out)


def late_data_stream(spark, sf_dir):
    """Events that arrive up to eight days after they happened, four days' at a time: how many of each arrival a watermark of 12 hours dropped, by the stream's own counts. Spark drops by the watermark that held one micro-batch before."""
    arrived = F.datediff(F.to_date(F.col("ts") + F.make_dt_interval((F.col("event_id") % 5 * 2).cast("int"))), F.lit("2024-01-01"))
    stream = _arrivals(spark, _events(spark, sf_dir).withColumn("part", F.floor(arrived / 4)), "part", 10, "late")
    return W.once_each_counted(stream, "event_id", "ts", "12 hours", _path(spark, "once"), _path(spark, "progress"))


def stream_roll_window(spark, sf_dir):
    """Roll changes as they arrive, with the last roll at or before their day."""
    data = star_views(spark, sf_dir).data
    changes = _stream(spark, data.roll_changes.select("unit_id", "day", "additions"), "changes")
    rows = J.with_snapshot(changes, data.snapshots)
    return _taken_in(spark, rows, ["unit_id", "day", "additions", "electors"], "unit_id", "append")


def stream_retention(spark, sf_dir):
    return J.retained(_events(spark, sf_dir), "ts", 10, "2024-01-25").select("event_id")


def late_data(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("arrived", F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 5).cast("int")))
    return J.late_rows(rows, "ts", "arrived", "2 HOURS")


QUERIES = {
    "form20_parse": form20_parse,
    "form20_validate": form20_validate,
    "ls_segment": ls_segment,
    "roll_scan": roll_scan,
    "resolve_column": resolve_column,
    "top3_candidates": top3_candidates,
    "area_resolve": area_resolve,
    "area_create": area_create,
    "guard_sql": guard_sql,
    "guard_sql_verdicts": guard_sql_verdicts,
    "str_comparable": lambda spark, sf_dir: read(spark, sf_dir, "part").select("p_partkey", X.comparable(F.col("p_name")).alias("name")),
    "sink_csv": sink_csv,
    "sink_upsert": sink_upsert,
    "sink_upsert_guarded": sink_upsert_guarded,
    "sink_delete_insert": sink_delete_insert,
    "sink_copy": sink_copy,
    "sink_geojson": sink_geojson,
    "refresh_mv": refresh_mv,
    "scan_feed": scan_feed,
    "stream_dedupe": stream_dedupe,
    "stream_dedupe_titles": stream_dedupe_titles,
    "stream_tumbling_week": stream_tumbling_week,
    "sched_jobs": sched_jobs,
    "stream_budget": stream_budget,
    "stream_budget_calls": stream_budget_calls,
    "stream_roll_window": stream_roll_window,
    "stream_retention": stream_retention,
    "late_data": late_data,
    "late_data_stream": late_data_stream,
}

_ROWS = f"""rows AS (SELECT p_partkey AS n, p_partkey // {SHEET} AS doc, p_partkey % {SHEET} + 1 AS station, p_size AS a, p_partkey % 7 AS b, p_partkey % 3 AS c, p_size % 4 AS nota, CAST(p_partkey % 101 = 0 AS INT) AS off
  FROM part, range(CASE WHEN p_partkey % 333 = 5 THEN 2 ELSE 1 END) WHERE p_partkey % 50 != 7)"""
#: The comparable form of ASCII names.
_COMPARABLE = "array_to_string([CASE WHEN length(w) > 3 AND ends_with(w, 'a') THEN w[:-2] ELSE w END FOR w IN string_split(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(p_name), 'ee', 'i'), 'oo', 'u'), 'aa+', 'a', 'g'), 'ii+', 'i', 'g'), 'uu+', 'u', 'g'), ' ')], ' ')"
_BANDS = ", ".join(f"count(*) FILTER (age {test}) AS \"age_{name}\"" for name, test in (("18-19", "< 20"), ("20-29", "BETWEEN 20 AND 29"), ("30-39", "BETWEEN 30 AND 39"), ("40-49", "BETWEEN 40 AND 49"), ("50-59", "BETWEEN 50 AND 59"), ("60+", ">= 60")))
_RESOLVED = "(0, 'nota', NULL, 'NOTA'), (1, 'alias+name', 1, 'XY'), (2, 'name', 2, 'AB'), (3, 'unresolved', NULL, NULL), (4, 'alias', NULL, 'CD'), (5, 'independent', NULL, 'IND')"
_FOLDED = "trim(regexp_replace(lower(p_type || ' ' || p_brand), ' +', ' ', 'g'))"
_ALL = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"
SQL = {
    "form20_parse": f"""WITH {_ROWS} SELECT doc, station, 'First' AS contestant, CAST(a AS BIGINT) AS votes FROM rows UNION ALL SELECT doc, station, 'Second', b FROM rows UNION ALL SELECT doc, station, 'Third', c FROM rows UNION ALL SELECT doc, station, 'NOTA', nota FROM rows""",
    "form20_validate": f"""WITH {_ROWS} SELECT doc, station, 'twice' AS kind, CAST(count(*) AS VARCHAR) AS detail FROM rows GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT doc, station, 'sum', '-1' FROM rows WHERE off = 1
  UNION ALL SELECT p_partkey // {SHEET} AS d, p_partkey % {SHEET} + 1 AS s, 'missing', NULL FROM part JOIN (SELECT doc, min(station) AS a, max(station) AS b FROM rows GROUP BY 1) e ON doc = p_partkey // {SHEET} AND p_partkey % {SHEET} + 1 BETWEEN a AND b WHERE p_partkey % 50 = 7""",
    "ls_segment": f"""WITH p AS (SELECT p_partkey // {PAGES} AS doc, p_partkey % {PAGES} AS page_no, CASE WHEN p_partkey % 5 = 3 THEN p_size END AS h, CASE WHEN p_partkey % 5 = 3 THEN p_type END AS t FROM part),
  f AS (SELECT doc, page_no, last_value(h IGNORE NULLS) OVER w AS segment, last_value(t IGNORE NULLS) OVER w AS name FROM p WINDOW w AS (PARTITION BY doc ORDER BY page_no ROWS UNBOUNDED PRECEDING)),
  s AS (SELECT *, coalesce(segment != lag(segment) OVER (PARTITION BY doc ORDER BY page_no), segment IS NOT NULL) AS new FROM f)
  SELECT * FROM (SELECT doc, page_no, CAST(segment AS BIGINT) AS segment, name, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY doc ORDER BY page_no) AS BIGINT) AS section FROM s) WHERE segment IS NOT NULL""",
    "roll_scan": f"""SELECT doc, CAST(doc % 999 AS BIGINT) AS station, CAST(7 AS BIGINT) AS part, count(*) AS electors, count(*) FILTER (g = 0) AS male, count(*) FILTER (g IN (1, 2)) AS female, count(*) FILTER (g = 3) AS other, {_BANDS},
  CAST(count(DISTINCT c_mktsegment) AS INT) AS names, count(*) FILTER (c_mktsegment = 'BUILDING') AS builders FROM (SELECT *, c_custkey // {ROLL} AS doc, 18 + c_custkey % 60 AS age, c_custkey % 4 AS g FROM customer) GROUP BY doc""",
    "resolve_column": f"SELECT n_nationkey AS contest_id, v.* FROM nation, (VALUES {_RESOLVED}) v(\"column\", method, candidate_id, party)",
    "top3_candidates": f"""WITH n AS (SELECT p_size AS contest_id, p_partkey AS id, {_COMPARABLE} AS k FROM part), s AS (SELECT a.contest_id, a.id AS "column", b.id AS candidate_id, floor(jaro_winkler_similarity(a.k, b.k) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS score FROM n a JOIN n b USING (contest_id) WHERE a.id % 9 = 0 AND b.id % 9 = 1)
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY contest_id, "column" ORDER BY score DESC, candidate_id) AS INT) AS place FROM s) WHERE place <= 3""",
    "area_resolve": "SELECT DISTINCT p_type || '-' || p_brand AS name, CASE WHEN p_brand LIKE '%1%' THEN CAST(length(p_type) AS INT) END AS area_id FROM part",
    "area_create": f"""WITH n AS (SELECT {_FOLDED} AS alias, p_type || '-' || p_brand AS name, p_size % 3 AS block_id FROM part WHERE p_size % 3 != 0 AND p_brand NOT LIKE '%1%')
  SELECT (SELECT coalesce(max(length(p_type)), 0) FROM part WHERE p_brand LIKE '%1%') + row_number() OVER (ORDER BY alias) AS area_id, CAST(min(block_id) AS INT) AS block_id, min(name) AS name, alias FROM n GROUP BY alias""",
    "guard_sql": _GUARDED,
    "guard_sql_verdicts": " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS statement, '{'accepted' if rows else 'rejected'}' AS verdict, CAST({rows or 'NULL'} AS BIGINT) AS rows" for i, (_, rows) in enumerate(_STATEMENTS)),
    "str_comparable": f"SELECT p_partkey, {_COMPARABLE} AS name FROM part",
    "sink_csv": _ALL,
    "sink_copy": _ALL,
    "sink_upsert": "SELECT p_partkey, p_name, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size + 100 ELSE p_size END AS INT) AS p_size FROM part WHERE p_partkey % 3 != 0 OR p_partkey % 2 = 0",
    "sink_upsert_guarded": "SELECT p_partkey, p_name, CAST(CASE WHEN p_partkey % 2 = 0 AND (p_partkey % 3 = 0 OR p_size < 25) THEN p_size + 100 ELSE p_size END AS INT) AS p_size FROM part WHERE p_partkey % 3 != 0 OR p_partkey % 2 = 0",
    "sink_delete_insert": "WITH c AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 2 = 0 AND p_size < 10) SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 != 0 AND p_size NOT IN (SELECT p_size FROM c) UNION ALL SELECT * FROM c",
    "sink_geojson": "SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 5 != 0 THEN 85.0::DOUBLE + c_custkey % 8 / 8.0::DOUBLE END AS lon, CASE WHEN c_custkey % 5 != 0 THEN 24.5::DOUBLE END AS lat FROM customer",
    "refresh_mv": over_views(" UNION ALL ".join(f"SELECT '{name}' AS view, count(*) AS rows FROM {name}" for name in ORDER)),
    "stream_dedupe_titles": SEQUENTIAL + " SELECT id, simhash FROM h JOIN last USING (id)",
    "scan_feed": "SELECT sha256(regexp_replace(regexp_replace(lower(trim(url)), '[?#](?s:.*)$', ''), '/+$', '')) AS url_hash, 'Page ' || page_id AS title, make_timestamp((1700000000 + page_id) * 1000000) AS published FROM pages WHERE page_id % 10 != 3 AND url IS NOT NULL",
    "stream_dedupe": "SELECT DISTINCT sha256(regexp_replace(regexp_replace(lower(trim(coalesce(url, ''))), '[?#](?s:.*)$', ''), '/+$', '')) AS url_hash FROM pages",
    "stream_tumbling_week": "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sched_jobs": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_budget": "SELECT user_id, day, used, CASE WHEN used >= 60 THEN 'blocked' WHEN used >= 48 THEN 'degraded' ELSE 'fine' END AS state FROM (SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(event_id % 50 + 1) AS BIGINT) AS used FROM events GROUP BY 1, 2)",
    "stream_budget_calls": """WITH c AS (SELECT user_id, event_id, ts, CAST(ts AS DATE) AS day, event_id % 50 + 1 AS tokens FROM events),
  s AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM c),
  u AS (SELECT *, least(before, coalesce(min(before) FILTER (before >= 60) OVER (PARTITION BY user_id, day), before)) AS used FROM s)
  SELECT user_id, event_id AS call_id, day, used, CASE WHEN used >= 60 THEN 'blocked' WHEN used >= 48 THEN 'degraded' ELSE 'fine' END AS state FROM u""",
    "stream_roll_window": over_views("SELECT DISTINCT c.unit_id, c.day, c.additions, s.electors FROM roll_changes c ASOF LEFT JOIN snapshots s ON c.unit_id = s.unit_id AND c.day >= s.day"),
    "stream_retention": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'",
    "late_data_stream": """WITH e AS (SELECT ts, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts + to_hours(event_id % 5 * 48))) // 4 AS part FROM events),
  b AS (SELECT part, max(ts) AS last FROM e GROUP BY 1),
  m AS (SELECT part, max(last) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS before, row_number() OVER (ORDER BY part) - 1 AS batch FROM b)
  SELECT batch, count(*) AS rows, min(ts) AS first, max(ts) AS last, count(*) FILTER (ts <= date_trunc('millisecond', before) - INTERVAL 12 HOURS) AS late FROM e JOIN m USING (part) GROUP BY batch""",
    "late_data": "SELECT CAST(ts AS DATE) AS day, count(*) AS rows, CAST(sum(CAST(event_id % 5 > 2 AS INT)) AS BIGINT) AS late FROM events GROUP BY 1",
}
