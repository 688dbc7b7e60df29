"""News, ground reports, usage and budgets, review queues, jobs and sources.

The star data's stand-ins: documents are news items (the language is the party that they name, parts of the id
the issues and groups), conversations the usage ledger (characters are tokens), events job runs, pages sources,
suppliers local offices. "Now" is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestlab.functions import metrics as M
from contestlab.operators.dedupe import dot

from .results import clamp
from .texts import read

ISSUES = ("roads", "water", "power", "schools", "jobs")
DAY_ONE, NOW = "2024-01-01", "2024-01-25"
#: Dollars for a million tokens read and written, by a part of the model's name; the last is for all others. Parameters.
PRICES = (("small", 1.0, 5.0), ("", 3.0, 15.0))
#: Fixed values.
CACHE_READ, CACHE_WRITE, BATCH, DEGRADE = 0.10, 1.25, 0.5, 0.8


def cost_micros(model: Column, fresh: Column, cached: Column, written: Column, out: Column, batch: Column, prices=PRICES) -> Column:
    """Cost in millionths of a dollar, exact in hundredths of them, rounded half up."""
    rate_in, rate_out = (F.lit(float(prices[-1][i])) for i in (1, 2))
    for name, a, b in reversed(prices[:-1]):
        rate_in, rate_out = F.when(F.lower(model).contains(name), a).otherwise(rate_in), F.when(F.lower(model).contains(name), b).otherwise(rate_out)
    cost = fresh * rate_in + cached * rate_in * CACHE_READ + written * rate_in * CACHE_WRITE + out * rate_out
    return F.floor(F.when(batch, cost * BATCH).otherwise(cost) + 0.5).cast("long")


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    issue = lambda k: F.lit(ISSUES[k])
    issues = F.array_compact(F.array(*(F.when((i + k) % (k + 2) == 0, issue(k)) for k in range(len(ISSUES)))))
    return read(spark, sf_dir, "documents").select(
        i.alias("news_id"), F.date_add(F.lit(DAY_ONE).cast("date"), (i % 30).cast("int")).alias("published"), "source", F.col("lang").alias("party"),
        issues.alias("issues"), F.array((i % 5).cast("int"), (i % 3).cast("int")).alias("groups"), F.array((i % 25).cast("int"), (i % 7).cast("int")).alias("areas"),
        (i % 5 - 2).alias("sentiment"), (i % 9 != 0).alias("labelled"), F.create_map(F.lit("a"), (i % 5 - 2).cast("int"), F.lit("b"), (i % 7 - 3).cast("int")).alias("by_party"),
    )


def news_list(items: DataFrame, group: int, since: str | None = None, until: str | None = None, issue: str | None = None, area: int | None = None, areas=None, unlabelled: bool = False, limit: int = 50) -> DataFrame:
    """The latest items of a group that pass all given filters."""
    tests = [F.array_contains("groups", group)]
    tests += [F.col("labelled")] if not unlabelled else []
    tests += [F.col("published") >= F.lit(since).cast("date")] if since else []
    tests += [F.col("published") <= F.lit(until).cast("date")] if until else []
    tests += [F.array_contains("issues", issue)] if issue else []
    tests += [F.array_contains("areas", area)] if area is not None else []
    tests += [F.arrays_overlap("areas", F.array(*map(F.lit, areas)))] if areas else []
    for test in tests:
        items = items.filter(test)
    return items.orderBy(F.desc("published"), F.desc("news_id")).limit(clamp(limit))


def news_similar(items: DataFrame, vectors: DataFrame, query: list[float], limit: int = 20) -> DataFrame:
    """Items with a vector (news_id, embedding), nearest first by cosine."""
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    near = dot(F.col("embedding"), q) / (F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * norm)
    rows = vectors.withColumn("similarity", near).join(items.select("news_id", "published", "party"), "news_id")
    return rows.select("news_id", "published", "party", "similarity").orderBy(F.desc("similarity"), "news_id").limit(clamp(limit))


def recent(items: DataFrame, group: int, days: int, now: str = NOW) -> DataFrame:
    return items.filter(F.col("labelled") & F.array_contains("groups", group) & (F.col("published") >= F.date_sub(F.lit(now).cast("date"), days)))


def by_issue(items: DataFrame) -> DataFrame:
    rows = items.select(F.explode("issues").alias("issue"), "sentiment").groupBy("issue")
    return rows.agg(F.count(F.lit(1)).alias("items"), M.ratio(F.sum("sentiment"), F.count("sentiment"), 2).alias("avg_sentiment"))


def by_week(items: DataFrame) -> DataFrame:
    return items.groupBy(F.date_trunc("week", "published").cast("date").alias("week")).agg(F.count(F.lit(1)).alias("items"))


def by_party(items: DataFrame) -> DataFrame:
    return items.groupBy("party").agg(F.count(F.lit(1)).alias("mentions"))


def ground_reports(spark, sf_dir, area: int = 3, limit: int = 50) -> DataFrame:
    """Reports of an area, by their unit's area or else their own."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("conv_id") % 3 != 0, F.col("conv_id")).alias("unit_id"), (F.col("turn") % 25).alias("own_area"), F.length("text").cast("long").alias("size"))
    rows = rows.join(c, F.col("unit_id") == F.col("c_custkey"), "left").withColumn("area_id", F.coalesce(F.col("c_nationkey").cast("long"), "own_area")).drop("c_custkey", "c_nationkey", "own_area")
    return rows.filter(F.col("area_id") == area).orderBy(F.desc("conv_id"), "turn").limit(clamp(limit))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger: one row a call."""
    k, n = F.col("conv_id"), F.length("text").cast("long")
    model = F.when(k % 2 == 0, "small-1").otherwise("large-1")
    rows = read(spark, sf_dir, "conversations").select(
        F.date_add(F.lit(DAY_ONE).cast("date"), (k % 30).cast("int")).alias("day"), (k % 10).alias("user_id"), model.alias("model"),
        F.when(F.col("role") == "user", "chat.ask").when(F.col("role") == "system", "label").otherwise("chat.answer").alias("purpose"),
        n.alias("fresh"), F.floor(n / 3).alias("cached"), F.floor(n / 5).alias("written"), F.floor(n / 2).alias("out"), (F.col("turn") % 4 == 3).alias("batch"),
    )
    return rows.withColumn("micros", cost_micros(*(F.col(c) for c in ("model", "fresh", "cached", "written", "out", "batch"))))


_TOKENS = ("fresh", "cached", "out")


def usage_by_day(u: DataFrame, days: int = 30, now: str = NOW) -> DataFrame:
    return u.filter(F.col("day") >= F.date_sub(F.lit(now).cast("date"), days)).groupBy("day", "model", "purpose").agg(*(F.sum(c).alias(c) for c in _TOKENS), F.sum("micros").alias("micros"), F.count(F.lit(1)).alias("calls"))


def usage_month(u: DataFrame, now: str = NOW) -> DataFrame:
    month = F.date_trunc("month", "day") == F.date_trunc("month", F.lit(now).cast("date"))
    return u.filter(month & (F.col("day") <= F.lit(now).cast("date"))).agg(F.coalesce(F.sum("micros"), F.lit(0)).alias("micros"), F.count(F.lit(1)).alias("calls"))


def cache_hits(u: DataFrame) -> DataFrame:
    return u.filter(F.startswith("purpose", F.lit("chat."))).agg(M.pct(F.sum("cached"), F.sum(F.col("cached") + F.col("fresh")), 1).alias("hit_pct"))


def usage_by_user(u: DataFrame, day: str) -> DataFrame:
    return u.filter(F.col("day") == F.lit(day).cast("date")).groupBy("user_id").agg(F.sum(sum((F.col(c) for c in _TOKENS), F.lit(0))).alias("tokens"), F.sum("micros").alias("micros"))


def usage_report(u: DataFrame, day: str) -> DataFrame:
    return u.filter(F.col("day") == F.lit(day).cast("date")).groupBy("purpose", "model").agg(F.sum("micros").alias("micros"), F.count(F.lit(1)).alias("calls"))


def budget(u: DataFrame, day: str, tokens: int, month_micros: int) -> DataFrame:
    """user_id, used, budget, state: over the day's tokens or the month's money, close to it, or fine."""
    spent = usage_month(u, day).select(F.col("micros").alias("spent"))
    used = u.groupBy("user_id").agg(F.coalesce(F.sum(F.when(F.col("day") == F.lit(day).cast("date"), sum((F.col(c) for c in _TOKENS), F.lit(0)))), F.lit(0)).alias("used"))
    over = (F.col("used") >= tokens) | (F.col("spent") >= month_micros)
    close = (F.col("used") >= tokens * DEGRADE) | (F.col("spent") >= month_micros * DEGRADE)
    # spent is one row
    return used.crossJoin(F.broadcast(spent)).select("user_id", "used", F.lit(tokens).alias("budget"), F.when(over, "blocked").when(close, "degraded").otherwise("fine").alias("state"))


def last_per_job(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("job")).agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return rows.select("job", F.col("m.event_id").alias("event_id"), F.col("m.value").alias("value"))


def recent_jobs(spark, sf_dir, job: str = "er", limit: int = 50) -> DataFrame:
    """The latest runs of the jobs whose name contains a text, in any case."""
    rows = read(spark, sf_dir, "events").filter(F.col("event_type").ilike(f"%{job}%"))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(clamp(limit, most=200)).select("event_id", "event_type", "value", F.get_json_object("props", "$.k").alias("k"))


def sources(spark, sf_dir, limit: int = 200) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", F.sha2("url", 256).alias("sha256"), F.length("html").cast("long").alias("size"))
    return rows.orderBy(F.desc("page_id")).limit(clamp(limit))


def review_counts(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "labels").filter("quality = 0")
    return rows.groupBy(F.when(F.col("toxic") == 1, "toxic").otherwise("low").alias("kind")).agg(F.count(F.lit(1)).alias("open"))


def link_status(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    method = F.when(k % 13 == 0, "manual").when((k * 37) % 40 + 60 >= 85, "fuzzy").otherwise("weak")
    sure = (k * 37) % 40 + 60
    rows = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("list"), method.alias("match_method"))
    return rows.agg(F.count(F.lit(1)).alias("n"), M.ratio(F.sum(sure), F.count(F.lit(1)) * 100, 3).alias("avg_confidence"), F.sum((k % 13 == 0).cast("long")).alias("reviewed"))


def offices(spark, sf_dir) -> DataFrame:
    """Holders of local offices with their area and tagged party."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area_id"), F.col("n_name").alias("area"))
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.element_at(F.array(F.lit("chair"), F.lit("member")), (F.col("s_suppkey") % 2 + 1).cast("int")).alias("office"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("area_id"))
    return rows.join(n, "area_id", "left")


def local_results(spark, sf_dir) -> DataFrame:
    """Winner and runner-up of each seat that has no parties; a seat is an area and an office."""
    rows = offices(spark, sf_dir).join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.floor("s_acctbal").alias("votes")), "id")
    place = F.row_number().over(Window.partitionBy("area_id", "office").orderBy(F.desc("votes"), "name"))
    at = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    rows = rows.withColumn("place", place).filter("place <= 2").groupBy("area_id", "area", "office").agg(at("name", 1).alias("winner"), at("votes", 1).alias("votes"), at("name", 2).alias("runner_up"), at("votes", 2).alias("runner_up_votes"))
    return rows.withColumn("margin", F.col("votes") - F.col("runner_up_votes"))


def local_events(spark, sf_dir, limit: int = 200) -> DataFrame:
    sign = F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "signup", 1).otherwise(0)
    rows = read(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("kind"), (F.col("user_id") % 25).alias("area_id"), sign.alias("effect_sign"))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(clamp(limit)).drop("ts")


def organisations(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "customer").filter(F.startswith("c_mktsegment", F.lit("B"))).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("community"))


def day_totals(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(M.hundredths(F.col("value"))).alias("value_h"))


def _news(f, *args, **kw):
    return lambda spark, sf_dir: f(news_items(spark, sf_dir), *args, **kw)


def _usage(f, *args):
    return lambda spark, sf_dir: f(usage(spark, sf_dir), *args)


_flat = lambda df: df.select("news_id", "published", "source", "party", F.array_join("issues", ",").alias("issues"), "sentiment")
QUERY = [0.5 if i % 2 else -0.25 for i in range(64)]
QUERIES = {
    "q_news_list": lambda spark, sf_dir: _flat(news_list(news_items(spark, sf_dir), 1, since="2024-01-05", until="2024-01-28", issue="water", limit=200)),
    "filt_array_overlap": lambda spark, sf_dir: _flat(news_list(news_items(spark, sf_dir), 2, areas=[3, 5], unlabelled=True, limit=500)),
    "q_news_similar": lambda spark, sf_dir: news_similar(news_items(spark, sf_dir), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("news_id"), "embedding"), QUERY).withColumn("similarity", F.round("similarity", 6)),
    "q_news_issues": lambda spark, sf_dir: by_issue(recent(news_items(spark, sf_dir), 1, 20)),
    "q_news_weeks": lambda spark, sf_dir: by_week(recent(news_items(spark, sf_dir), 1, 20)),
    "q_news_parties": lambda spark, sf_dir: by_party(recent(news_items(spark, sf_dir), 1, 20)),
    "json_map_avg": lambda spark, sf_dir: news_items(spark, sf_dir).select("news_id", (F.aggregate(F.map_values("by_party"), F.lit(0), lambda s, x: s + x) / F.size("by_party")).alias("mean")),
    "q_ground_reports": ground_reports,
    "llm_cost": lambda spark, sf_dir: usage(spark, sf_dir).groupBy("model", "batch").agg(F.sum("micros").alias("micros")),
    "q_usage_by_day": _usage(usage_by_day),
    "q_usage_month": _usage(usage_month),
    "q_usage_cache": _usage(cache_hits),
    "q_usage_by_user": _usage(usage_by_user, "2024-01-10"),
    "q_usage_report": _usage(usage_report, "2024-01-10"),
    "q_budget": _usage(budget, "2024-01-10", 20_000, 5_000_000),
    "q_jobs": last_per_job,
    "q_jobs_recent": recent_jobs,
    "q_sources": sources,
    "q_review_queue": review_counts,
    "q_crosswalk_status": link_status,
    "q_local_politics": offices,
    "q_local_events": local_events,
    "q_local_organisations": organisations,
    "q_local_results": local_results,
    "agg_time_bucket": day_totals,
}
_ITEMS = f"""n AS (SELECT doc_id AS news_id, CAST(DATE '{DAY_ONE}' + CAST(doc_id % 30 AS INT) AS DATE) AS published, source, lang AS party, list_filter([{", ".join(f"CASE WHEN (doc_id + {k}) % {k + 2} = 0 THEN '{x}' END" for k, x in enumerate(ISSUES))}], lambda x: x IS NOT NULL) AS issues,
  [CAST(doc_id % 5 AS INT), CAST(doc_id % 3 AS INT)] AS groups, [CAST(doc_id % 25 AS INT), CAST(doc_id % 7 AS INT)] AS areas, doc_id % 5 - 2 AS sentiment, doc_id % 9 != 0 AS labelled FROM documents),
recent AS (FROM n WHERE labelled AND list_contains(groups, 1) AND published >= DATE '{NOW}' - 20)"""
_LIST = "SELECT news_id, published, source, party, array_to_string(issues, ',') AS issues, sentiment FROM n WHERE "
_LEDGER = f"""u AS (SELECT *, CAST(floor((CASE WHEN batch THEN {BATCH}::DOUBLE ELSE 1.0::DOUBLE END) * (fresh * i + cached * i * {CACHE_READ}::DOUBLE + written * i * {CACHE_WRITE}::DOUBLE + out * o) + 0.5::DOUBLE) AS BIGINT) AS micros FROM
  (SELECT CAST(DATE '{DAY_ONE}' + CAST(conv_id % 30 AS INT) AS DATE) AS day, conv_id % 10 AS user_id, CASE WHEN conv_id % 2 = 0 THEN 'small-1' ELSE 'large-1' END AS model, CASE role WHEN 'user' THEN 'chat.ask' WHEN 'system' THEN 'label' ELSE 'chat.answer' END AS purpose,
  length(text) AS fresh, length(text) // 3 AS cached, length(text) // 5 AS written, length(text) // 2 AS out, turn % 4 = 3 AS batch, CASE WHEN conv_id % 2 = 0 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END AS i, CASE WHEN conv_id % 2 = 0 THEN 5.0::DOUBLE ELSE 15.0::DOUBLE END AS o FROM conversations))"""
_SUM = lambda *cs: ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in cs)
_OFFICES = "SELECT s_suppkey AS id, ['chair', 'member'][s_suppkey % 2 + 1] AS office, s_name AS name, s_nationkey AS area_id, n_name AS area FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"
_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"
SQL = {
    "q_news_list": f"WITH {_ITEMS} {_LIST} list_contains(groups, 1) AND labelled AND published BETWEEN DATE '2024-01-05' AND DATE '2024-01-28' AND list_contains(issues, 'water') ORDER BY published DESC, news_id DESC LIMIT 200",
    "filt_array_overlap": f"WITH {_ITEMS} {_LIST} list_contains(groups, 2) AND list_has_any(areas, [3, 5]) ORDER BY published DESC, news_id DESC LIMIT 500",
    "q_news_similar": f"WITH {_ITEMS}, s AS (SELECT vec_id AS news_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}) AS s FROM embeddings) SELECT news_id, published, party, round(s, 6) AS similarity FROM s JOIN n USING (news_id) ORDER BY s DESC, news_id LIMIT 20",
    "q_news_issues": f"WITH {_ITEMS} SELECT issue, count(*) AS items, sign(sum(sentiment)) * floor((abs(sum(sentiment)) * 200 + count(*)) / (count(*) * 2)) / 100.0::DOUBLE AS avg_sentiment FROM (SELECT unnest(issues) AS issue, sentiment FROM recent) GROUP BY 1",
    "q_news_weeks": f"WITH {_ITEMS} SELECT CAST(date_trunc('week', published) AS DATE) AS week, count(*) AS items FROM recent GROUP BY 1",
    "q_news_parties": f"WITH {_ITEMS} SELECT party, count(*) AS mentions FROM recent GROUP BY 1",
    "json_map_avg": "SELECT doc_id AS news_id, CAST(doc_id % 5 - 2 + doc_id % 7 - 3 AS DOUBLE) / 2 AS mean FROM documents",
    "q_ground_reports": """SELECT * FROM (SELECT conv_id, turn, role, CASE WHEN conv_id % 3 != 0 THEN conv_id END AS unit_id, length(text) AS size, coalesce(CAST(c_nationkey AS BIGINT), turn % 25) AS area_id
  FROM conversations LEFT JOIN customer ON conv_id % 3 != 0 AND conv_id = c_custkey) WHERE area_id = 3 ORDER BY conv_id DESC, turn LIMIT 50""",
    "llm_cost": f"WITH {_LEDGER} SELECT model, batch, {_SUM('micros')} FROM u GROUP BY 1, 2",
    "q_usage_by_day": f"WITH {_LEDGER} SELECT day, model, purpose, {_SUM('fresh', 'cached', 'out', 'micros')}, count(*) AS calls FROM u WHERE day >= DATE '{NOW}' - 30 GROUP BY 1, 2, 3",
    "q_usage_month": f"WITH {_LEDGER} SELECT CAST(coalesce(sum(micros), 0) AS BIGINT) AS micros, count(*) AS calls FROM u WHERE date_trunc('month', day) = DATE '2024-01-01' AND day <= DATE '{NOW}'",
    "q_usage_cache": f"WITH {_LEDGER} SELECT floor((sum(cached) * 2000 + sum(cached + fresh)) / (sum(cached + fresh) * 2)) / 10.0::DOUBLE AS hit_pct FROM u WHERE starts_with(purpose, 'chat.')",
    "q_usage_by_user": f"WITH {_LEDGER} SELECT user_id, CAST(sum(fresh + cached + out) AS BIGINT) AS tokens, {_SUM('micros')} FROM u WHERE day = DATE '2024-01-10' GROUP BY 1",
    "q_usage_report": f"WITH {_LEDGER} SELECT purpose, model, {_SUM('micros')}, count(*) AS calls FROM u WHERE day = DATE '2024-01-10' GROUP BY 1, 2",
    "q_budget": f"""WITH {_LEDGER}, s AS (SELECT coalesce(sum(micros), 0) AS spent FROM u WHERE date_trunc('month', day) = DATE '2024-01-01' AND day <= DATE '2024-01-10'),
t AS (SELECT user_id, CAST(coalesce(sum(fresh + cached + out) FILTER (day = DATE '2024-01-10'), 0) AS BIGINT) AS used FROM u GROUP BY 1)
SELECT user_id, used, 20000 AS budget, CASE WHEN used >= 20000 OR spent >= 5000000 THEN 'blocked' WHEN used >= 16000 OR spent >= 4000000 THEN 'degraded' ELSE 'fine' END AS state FROM t, s""",
    "q_jobs": "SELECT DISTINCT ON (event_type) event_type AS job, event_id, value FROM events ORDER BY event_type, ts DESC, event_id DESC",
    "q_jobs_recent": "SELECT event_id, event_type, value, regexp_extract(props, '\"k\": *([0-9]+)', 1) AS k FROM events WHERE event_type ILIKE '%er%' ORDER BY ts DESC, event_id DESC LIMIT 50",
    "q_sources": "SELECT page_id, sha256(url) AS sha256, length(html) AS size FROM pages ORDER BY page_id DESC LIMIT 200",
    "q_review_queue": "SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'low' END AS kind, count(*) AS open FROM labels WHERE quality = 0 GROUP BY 1",
    "q_crosswalk_status": """SELECT c_mktsegment AS list, CASE WHEN c_custkey % 13 = 0 THEN 'manual' WHEN (c_custkey * 37) % 40 + 60 >= 85 THEN 'fuzzy' ELSE 'weak' END AS match_method, count(*) AS n,
  floor((sum((c_custkey * 37) % 40 + 60) * 2000 + count(*) * 100) / (count(*) * 200)) / 1000.0::DOUBLE AS avg_confidence, count(*) FILTER (c_custkey % 13 = 0) AS reviewed FROM customer GROUP BY 1, 2""",
    "q_local_politics": _OFFICES,
    "q_local_events": "SELECT event_id, event_type AS kind, user_id % 25 AS area_id, CAST(CASE event_type WHEN 'error' THEN -1 WHEN 'signup' THEN 1 ELSE 0 END AS INT) AS effect_sign FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "q_local_organisations": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS community FROM customer WHERE c_mktsegment LIKE 'B%'",
    "q_local_results": f"""WITH o AS (SELECT o.*, CAST(floor(s_acctbal) AS BIGINT) AS votes FROM ({_OFFICES}) o JOIN supplier ON id = s_suppkey), r AS (SELECT *, row_number() OVER (PARTITION BY area_id, office ORDER BY votes DESC, name) AS place FROM o)
SELECT w.area_id, w.area, w.office, w.name AS winner, w.votes, r.name AS runner_up, r.votes AS runner_up_votes, w.votes - r.votes AS margin FROM r w LEFT JOIN r r ON r.area_id = w.area_id AND r.office = w.office AND r.place = 2 WHERE w.place = 1""",
    "agg_time_bucket": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(floor(abs(value) * 100.0::DOUBLE + 0.5::DOUBLE) * sign(value) AS BIGINT)) AS BIGINT) AS value_h FROM events GROUP BY 1, 2",
}
