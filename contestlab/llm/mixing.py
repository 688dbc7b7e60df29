"""Mixing sources to target weights by iterative proportional fitting.

Every document falls into one cell of source x language x topic and weighs as many tokens (words) as it has.
The cells' token totals are raked: in turn, each marginal's cells are scaled until its totals meet the target
shares, for a fixed number of rounds. A cell's factor divided by the largest factor is the probability with
which its documents are kept, so the expected kept tokens have the raked proportions. The draw is a hash of
the document's id: the same document is always drawn alike.

With keep, the scale is that share of all tokens instead: cells are raked to their marginals' shares of it, no cell
is drawn with more than 1, and what a full cell can't give falls to the others of its labels in the next round. So a
cell or label with few tokens can't shrink the draw. A label whose tokens don't reach its share comes whole, and only
what is missing there is missing in the total.

Targets not given are tempered: a label's share is its natural share to the power TEMPER, so a hot source
is held back and rare ones gain. Given targets are {label: share}; labels without one get 0 and are dropped.

DataFrame expressions only. The raking runs over the table of cells, which has no more rows than sources x
languages x topics that occur, in one job while they are few, by sums and joins beyond that; documents meet it in a join that Spark broadcasts only if the table's measured
size is under its own threshold. Documents are pre-aggregated to cells before any shuffle.

Defined cases: null and empty labels are one label, ''. A null or blank text weighs 0 tokens and shares its
cell's probability; a cell, or a marginal, without tokens keeps factor 1. A null doc_id is drawn by its text.
Repeated rows are drawn alike. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, free_name, materialize, table

TEMPER, ROUNDS = 0.85, 8
#: Cells that one task may rake.
FEW = 100_000
#: Share of the tokens that the query and the pipeline keep.
KEEP = 0.5
MARGINALS = ("source", "lang", "topic")
#: topic: strings one of which a text of that topic holds; the first topic that fits counts.
TOPICS = (
    ("legal", ("License", "Copyright")),
    ("contact", ("@", "://")),
    ("tabular", (" | ",)),
    ("symbols", ("###", "$$$", "%%%", "&&&", "***")),
)


def topic_of(text: Column) -> Column:
    topic = F.lit("prose")
    for name, marks in reversed(TOPICS):
        found = text.contains(marks[0])
        for mark in marks[1:]:
            found = found | text.contains(mark)
        topic = F.when(found, name).otherwise(topic)
    return topic


def _draw(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _goals(cells: DataFrame, m: str, given: Mapping[str, float] | None, temper: float, keep: float | None) -> DataFrame:
    """m, goal: what the tokens of each label are to be in proportion to, or with keep, to come to."""
    sums = cells.groupBy(m).agg(F.sum("w").alias("own"))
    if given is None:
        goals = sums.withColumn("goal", F.pow("own", F.lit(temper)))
    else:
        shares = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{m} string, goal double")
        goals = sums.join(shares, m, "left").withColumn("goal", F.coalesce("goal", F.lit(0.0)))
    if keep is None:
        return goals.select(m, "goal")
    # one row
    whole = goals.agg(F.sum("own").alias("all"), F.sum(F.when(F.col("own") > 0, F.col("goal")).otherwise(0.0)).alias("parts"))
    scaled = F.when(F.col("parts") > 0, F.lit(float(keep)) * F.col("all") * F.col("goal") / F.col("parts")).otherwise(0.0)
    return goals.crossJoin(whole).select(m, scaled.alias("goal"))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS, temper: float = TEMPER, keep: float | None = None, few: int = FEW) -> DataFrame:
    """cells (source, lang, topic, w) with p, the probability to keep a document of the cell; keep: the share of all tokens to keep.

    Up to `few` cells are raked in one job, all steps as windows over one partition. Beyond that each step sums the cells by label and joins
    the sums back, so no label's cells meet in one task, and is written before the next, so the plan stays short.
    """
    begun = materialize(cells.select(*MARGINALS, "w", F.lit(1.0 if keep is None else float(keep)).alias("f")), "raked")
    now = begun
    for m in MARGINALS:
        now = now.join(_goals(begun, m, (targets or {}).get(m), temper, keep).withColumnRenamed("goal", f"goal_{m}"), m)
    goals = [f"goal_{m}" for m in MARGINALS]
    now = now.select(*MARGINALS, "w", "f", *goals)
    small = begun.count() <= few
    now = now.coalesce(1) if small else materialize(now, "raked")
    for _ in range(rounds):
        for m in MARGINALS:
            mass = F.sum(F.col("w") * F.col("f"))
            step = now.withColumn("mass", mass.over(Window.partitionBy(m))) if small else now.join(now.groupBy(m).agg(mass.alias("mass")), m)
            raked = F.col("f") * F.col(f"goal_{m}") / F.col("mass")
            f = F.when(F.col("mass") > 0, raked if keep is None else F.least(raked, F.lit(1.0))).otherwise(F.col("f"))
            step = step.select(*MARGINALS, "w", f.alias("f"), *goals)
            if small:
                now = step
            else:
                old, now = now, materialize(step, "raked")
                discard(old)
    if small:
        now = materialize(now, "raked")
    discard(begun)
    if keep is not None:
        return now.select(*MARGINALS, F.when(F.col("w") > 0, F.col("f")).otherwise(1.0).alias("p"))
    # the targets of a marginal need not sum to 1: the factors' common scale falls out here; cells without tokens keep all
    most = now.agg(F.max(F.when(F.col("w") > 0, F.col("f"))).alias("most"))
    return now.crossJoin(most).select(*MARGINALS, F.when((F.col("w") > 0) & (F.col("most") > 0), F.least(F.col("f") / F.col("most"), F.lit(1.0))).otherwise(1.0).alias("p"))


def sample_to_targets(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = TEMPER, topic: Column | None = None, details: bool = False, keep: float | None = None) -> DataFrame:
    """The rows of docs that are drawn; details: instead their doc_id, labels, n_tokens and p in millionths; keep: as in rake."""
    names = {m: free_name(docs, f"mix_{m}") for m in (*MARGINALS, "tokens", "key", "p")}
    text = F.col("text").cast("string")
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    marked = docs.withColumns({
        names["source"]: label("source"),
        names["lang"]: label("lang"),
        names["topic"]: F.coalesce(topic_of(text) if topic is None else topic, F.lit("")),
        names["tokens"]: F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"),
        names["key"]: F.coalesce(F.col("doc_id").cast("string"), text, F.lit("")),
    })
    keys = [names[m] for m in MARGINALS]
    cells = marked.groupBy(*(F.col(names[m]).alias(m) for m in MARGINALS)).agg(F.sum(names["tokens"]).cast("double").alias("w"))
    cells = materialize(rake(cells, targets, temper=temper, keep=keep).select(*(F.col(m).alias(names[m]) for m in MARGINALS), F.col("p").alias(names["p"])), "cells")
    if details:
        marked = marked.select("doc_id", *keys, names["tokens"], names["key"])
    kept = marked.join(cells, keys).filter(_draw(F.col(names["key"])) < F.col(names["p"]))
    if not details:
        return kept.select(*docs.columns)
    return kept.select("doc_id", *(F.col(names[m]).alias(m) for m in MARGINALS), F.col(names["tokens"]).alias("n_tokens"), F.floor(F.col(names["p"]) * 1e6).cast("long").alias("p_millionths"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return sample_to_targets(docs, details=True, keep=KEEP)


def _sql() -> str:
    topics = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(text, '{m}')" for m in marks) + f" THEN '{name}'" for name, marks in TOPICS) + " WHEN text IS NULL THEN 'prose' ELSE 'prose' END"
    steps, at = [], "r0"
    for i in range(ROUNDS):
        for m in MARGINALS:
            to = f"r{i}_{m}"
            steps.append(f"{to} AS (SELECT * REPLACE (CASE WHEN mass > 0 THEN least(f * t_{m} / mass, 1.0::DOUBLE) ELSE f END AS f) FROM (SELECT * EXCLUDE (mass), sum(w * f) OVER (PARTITION BY {m}) AS mass FROM {at}))")
            at = to
    tempered = ", ".join(f"pow(sum(w) OVER (PARTITION BY {m}), {TEMPER}) AS t_{m}, sum(w) OVER (PARTITION BY {m}) AS own_{m}" for m in MARGINALS)
    scaled = ", ".join(f"{KEEP}::DOUBLE * sum(w) OVER () * t_{m} / sum(CASE WHEN own_{m} > 0 THEN t_{m} * w / own_{m} ELSE 0 END) OVER () AS t_{m}" for m in MARGINALS)
    words = "len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topics} AS topic, CAST(coalesce({words}, 0) AS BIGINT) AS n_tokens, coalesce(CAST(doc_id AS VARCHAR), text, '') AS key FROM documents),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS w FROM d GROUP BY ALL),
own AS (SELECT *, {tempered} FROM cells),
r0 AS (SELECT source, lang, topic, w, CAST({KEEP} AS DOUBLE) AS f, {scaled}, CAST(0 AS DOUBLE) AS mass FROM own),
{", ".join(steps)},
p AS (SELECT source, lang, topic, CASE WHEN w > 0 THEN f ELSE 1.0 END AS p FROM {at})
SELECT doc_id, source, lang, topic, n_tokens, CAST(floor(p * 1e6) AS BIGINT) AS p_millionths FROM d JOIN p USING (source, lang, topic)
WHERE CAST(CAST('0x' || substr(md5(key), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 < p"""


QUERIES = {"op7_raked_mixture": op7}
SQL = {"op7_raked_mixture": _sql()}
