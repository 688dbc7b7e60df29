"""URL filters: host rules first, then an empirical-Bayes reputation of the host.

A page is labelled by the row of `labels` with its id; quality 0 is a bad outcome. Bad outcomes are counted
by host and shrunk through three beta-binomial levels: the suffix towards the overall rate, the registered
domain towards its suffix, the host towards its domain. The strength of each prior is estimated by moments
from the spread of the rates of that level (the intra-class correlation rho gives strength 1/rho - 1). A host is blocked if
the lower bound of its posterior bad rate, mean - z * deviation, is above a threshold.

All of it is DataFrame expressions. Counts are pre-aggregated by host before they are shuffled; the host
table is written once, all levels are worked out from it, and it is joined back without a hint, so a hot host is
split by the adaptive join.

Defined cases: a null url or one without '://' has an empty host and path, fits no rule, and is judged by the
reputation of the empty host. Hosts without labelled pages are judged by their domain's posterior. Labels
that are null don't count; of several labels for one id each counts. Without any label nothing is blocked.
Repeated pages come out as often as they went in; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

#: host, path, verdict. Fixed values of the contract.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Suffixes of two labels; every other suffix is the last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")
Z, MAX_BAD = 1.645, 0.2
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def split_url(url: Column) -> tuple[Column, Column]:
    """host, path of the contract; both empty if url is null or has no '://'."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """rule, verdict of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _parents(host: Column, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """domain, suffix."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last2 = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    k = F.when(last2.isin(*two_labels), 2).otherwise(1)
    cut = lambda m: F.array_join(F.slice(labels, F.greatest(n - m + 1, F.lit(1)), m), ".")
    return cut(k + 1), cut(k)


def _strength(counts: DataFrame, mean: DataFrame) -> DataFrame:
    """One row: the prior strength by moments of the groups' rates about the overall mean."""
    s = counts.filter("n > 0").crossJoin(mean).select("n", "mu", (F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mu"), 2)).alias("d"))
    s = s.agg(F.count(F.lit(1)).alias("k"), F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"), F.sum("d").alias("d"), F.max("mu").alias("mu"))
    v = F.col("mu") * (1 - F.col("mu"))
    rest = F.col("n") - F.try_divide(F.col("nn"), F.col("n")) - (F.col("k") - 1)
    rho = F.try_divide(F.col("d") - v * (F.col("k") - 1), v * rest)
    found = F.when(rho > 0, 1 / rho - 1).otherwise(MOST_STRENGTH)
    return s.select(F.least(F.greatest(F.coalesce(found, F.lit(MOST_STRENGTH)), F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)).alias("m"))


def host_reputation(pages: DataFrame, labels: DataFrame, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """host, n_labelled, n_bad, a, b: the posterior Beta(a, b) of the bad rate for every host of pages. two_labels: suffixes of two labels."""
    mine = pages.select(F.col("page_id").cast("long").alias("id"), split_url(F.col("url"))[0].alias("host"))
    seen = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("quality") == 0).cast("long")).alias("bad"))
    hosts = mine.join(seen, "id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = _parents(F.col("host"), two_labels)
    hosts = materialize(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    mean = suffixes.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")), F.lit(0.0)).alias("mu"))
    n, bad, m, p = F.col("n"), F.col("bad"), F.col("m"), F.col("p")
    # one-row tables: the crossJoin adds columns, never rows
    top = suffixes.crossJoin(mean).crossJoin(_strength(suffixes, mean)).select("suffix", ((bad + m * F.col("mu")) / (n + m)).alias("p"))
    mid = domains.join(top, "suffix").crossJoin(_strength(domains, mean)).select("domain", "suffix", ((bad + m * p) / (n + m)).alias("p"))
    low = hosts.join(mid, ["domain", "suffix"]).crossJoin(_strength(hosts, mean))
    return low.select("host", n.alias("n_labelled"), bad.alias("n_bad"), (bad + m * p).alias("a"), (n - bad + m * (1 - p)).alias("b"))


def judge_pages(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, z: float = Z, max_bad: float = MAX_BAD, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, n_bad for each row of pages."""
    a, b = F.col("a"), F.col("b")
    bound = a / (a + b) - z * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    judged = host_reputation(pages, labels, two_labels).select("host", "n_labelled", "n_bad", F.when(bound > max_bad, "block").otherwise("allow").alias("own"))
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    return rows.join(judged, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "own").alias("verdict"), "n_labelled", "n_bad")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _sql() -> str:
    cases = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{v if what else h + p}'" for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))) + " END"
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)

    def strength(t: str) -> str:
        return f"""(SELECT least(greatest(coalesce(CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE {MOST_STRENGTH} END, {MOST_STRENGTH}), {LEAST_STRENGTH}), {MOST_STRENGTH}) AS m FROM (
            SELECT (d - mu * (1 - mu) * (k - 1)) / nullif(mu * (1 - mu) * (n - nn / nullif(n, 0) - (k - 1)), 0) AS rho FROM (
                SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n * n) AS DOUBLE) AS nn, sum(n * pow(bad / n - mu, 2)) AS d, max(mu) AS mu FROM {t}, mean WHERE n > 0)))"""

    return f"""
WITH p0 AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p0),
seen AS (SELECT doc_id, count(*) AS n, sum(CAST(quality = 0 AS BIGINT)) AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, string_split(host, '.') AS l, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad FROM p LEFT JOIN seen ON page_id = doc_id GROUP BY 1, 2),
h1 AS (SELECT *, CASE WHEN array_to_string(l[-2:], '.') IN ({two}) THEN 2 ELSE 1 END AS k FROM h0),
hosts AS (SELECT host, array_to_string(l[-(k + 1):], '.') AS domain, array_to_string(l[-k:], '.') AS suffix, n, bad FROM h1),
domains AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM domains GROUP BY 1),
mean AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS mu FROM suffixes),
top AS (SELECT suffix, (bad + m * mu) / (n + m) AS p FROM suffixes, mean, {strength("suffixes")}),
mid AS (SELECT domain, suffix, (bad + m * p) / (n + m) AS p FROM domains JOIN top USING (suffix), {strength("domains")}),
low AS (SELECT host, n, bad, bad + m * p AS a, n - bad + m * (1 - p) AS b FROM hosts JOIN mid USING (domain, suffix), {strength("hosts")}),
judged AS (SELECT host, n AS n_labelled, bad AS n_bad, CASE WHEN a / (a + b) - {Z} * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) > {MAX_BAD} THEN 'block' ELSE 'allow' END AS own FROM low)
SELECT page_id, host, path, {cases(False)} AS rule, coalesce({cases(True)}, own) AS verdict, n_labelled, n_bad FROM p LEFT JOIN judged USING (host)"""


QUERIES = {"op10_url_reputation": op10}
SQL = {"op10_url_reputation": _sql()}
