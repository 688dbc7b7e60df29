"""Aggregate estimates of communities per unit from surname counts, census and surveys; nothing finer than a unit.

All steps are DataFrame operations on (unit, community) rows. Units whose shares don't add up to 100 keep the
rest as a row of its own, UNMATCHED.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
OWN_WEIGHT, CENSUS_WEIGHT = 0.7, 0.3
SURVEY_CONFIDENCE, CONFIDENT_WEIGHT = 0.9, 0.8
CENSUS_HALF_LIFE = 20
UNMATCHED = "UNMATCHED"
#: A half, and a little for what sums of doubles lose.
HALF = 0.5 + 1e-7


def surname_counts(histogram: DataFrame, dictionary: DataFrame) -> DataFrame:
    """unit_id, community, n: a histogram (unit_id, surname, n) through a weighted dictionary (surname, community, weight)."""
    rows = histogram.join(dictionary, "surname")
    return rows.groupBy("unit_id", "community").agg(F.sum(F.col("n") * F.col("weight")).alias("n"))


def token_quality(histogram: DataFrame, dictionary: DataFrame) -> DataFrame:
    """unit_id, matched, confident: tokens that the dictionary knows, and those it is sure of."""
    by_name = dictionary.groupBy("surname").agg(F.sum(F.when(F.col("weight") >= CONFIDENT_WEIGHT, F.col("weight")).otherwise(0.0)).alias("sure"))
    rows = histogram.join(by_name, "surname")
    return rows.groupBy("unit_id").agg(F.sum("n").alias("matched"), F.sum(F.col("n") * F.col("sure")).alias("confident"))


def surname_estimates(histogram: DataFrame, dictionary: DataFrame) -> DataFrame:
    """unit_id, community, est_count, est_pct, confidence from surnames alone: shares of the matched tokens."""
    counts = surname_counts(histogram, dictionary)
    whole = F.sum("n").over(Window.partitionBy("unit_id"))
    rows = counts.join(token_quality(histogram, dictionary), "unit_id")
    sure = F.least(F.lit(1.0), F.try_divide(F.col("confident"), F.col("matched")))
    return rows.select("unit_id", "community", F.floor(F.col("n") + 0.5).alias("est_count"), (F.floor(F.try_divide(F.col("n"), whole) * 10000.0 + 0.5) / 100.0).alias("est_pct"), (F.floor(sure * 1000.0 + 0.5) / 1000.0).alias("confidence"))


def _rescaled(rows: DataFrame, category: str, census: str) -> DataFrame:
    """The category's shares scaled to its target; all others share what is left of the unit's total, so that the
    unmatched part stays unmatched. A target without any member goes to the category's 'other' community."""
    unit = Window.partitionBy("unit_id")
    mine = F.col("category") == category
    target = OWN_WEIGHT * F.col(f"own_{category}") + CENSUS_WEIGHT * F.col(census)
    rows = rows.withColumns({"now": F.sum(F.when(mine, F.col("pct"))).over(unit), "all": F.sum("pct").over(unit), "goal": target, "has_other": F.max((mine & F.col("is_other")).cast("int")).over(unit)})
    now = F.coalesce("now", F.lit(0.0))
    applies = F.col("goal").isNotNull() & ((now > 0) | ((F.col("goal") > 0) & (F.col("has_other") == 1)))
    rest = F.col("all") - now
    left = F.greatest(F.greatest(F.col("all"), F.col("goal")) - F.col("goal"), F.lit(0.0))
    scaled = F.when(mine & (now > 0), F.col("pct") * F.col("goal") / now).when(mine & F.col("is_other"), F.col("goal")).when(mine, F.col("pct")).otherwise(F.when(rest > 0, F.col("pct") * left / rest).otherwise(F.col("pct")))
    return rows.withColumn("pct", F.when(applies, scaled).otherwise(F.col("pct"))).drop("now", "all", "goal", "has_other")


def blend(units: DataFrame, counts: DataFrame, communities: DataFrame, survey: DataFrame | None, year: int) -> DataFrame:
    """unit_id, community, est_pct, est_count, confidence.

    units: unit_id, electors, matched, confident, census_sc, census_st, census_year; counts: unit_id, community, n;
    communities: community, category, is_other (one of a category at most); survey: unit_id, community, n, which
    overrides all else where it exists.
    """
    known = units.filter("electors > 0")
    # 'other' communities take part in each unit with 0, so that a census target has somewhere to go
    # communities are a dictionary of a fixed size
    shares = counts.join(known.select("unit_id", "electors"), "unit_id").select("unit_id", "community", (F.col("n") * 100.0 / F.col("electors")).alias("pct"))
    spare = shares.select("unit_id").distinct().crossJoin(communities.filter("is_other").select("community")).withColumn("pct", F.lit(0.0))
    rows = shares.unionByName(spare).groupBy("unit_id", "community").agg(F.sum("pct").alias("pct")).join(communities, "community", "left")
    rows = rows.withColumn("is_other", F.coalesce("is_other", F.lit(False))).join(known.select("unit_id", "census_sc", "census_st"), "unit_id")
    unit = Window.partitionBy("unit_id")
    rows = rows.withColumns({f"own_{c}": F.coalesce(F.sum(F.when(F.col("category") == c, F.col("pct"))).over(unit), F.lit(0.0)) for c in ("SC", "ST")})
    for category, census in (("SC", "census_sc"), ("ST", "census_st")):
        rows = _rescaled(rows, category, census)
    estimate = rows.filter("pct > 0").select("unit_id", "community", F.col("pct").alias("est_pct"))
    cover = F.least(F.lit(1.0), F.coalesce(F.col("matched") / F.col("electors"), F.lit(0.0)))
    quality = F.coalesce(F.try_divide(F.col("confident"), F.col("matched")), F.lit(0.0))
    fresh = F.when(F.col("census_year").isNotNull(), F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0), year - F.col("census_year")) / float(CENSUS_HALF_LIFE))).otherwise(0.0)
    sure = F.least(F.lit(1.0), 0.6 * cover + 0.2 * fresh + 0.2 * quality)
    trust = known.select("unit_id", "electors", (F.floor(sure * 1000.0 + 0.5) / 1000.0).alias("confidence"))
    out = estimate.join(trust, "unit_id")
    if survey is not None:
        asked = survey.select("unit_id").distinct()
        pct = F.col("n") * 100.0 / F.sum("n").over(unit)
        stated = survey.select("unit_id", "community", pct.alias("est_pct")).join(units.select("unit_id", "electors"), "unit_id", "left").withColumn("confidence", F.lit(SURVEY_CONFIDENCE))
        out = out.join(asked, "unit_id", "left_anti").unionByName(stated)
    gap = out.groupBy("unit_id").agg(F.first("electors").alias("electors"), F.first("confidence").alias("confidence"), (100.0 - F.sum("est_pct")).alias("est_pct")).filter("est_pct > 1e-9")
    out = out.unionByName(gap.select("unit_id", F.lit(UNMATCHED).alias("community"), "est_pct", "electors", "confidence"))
    return out.select("unit_id", "community", "est_pct", F.floor(F.col("est_pct") * F.col("electors") / 100.0 + HALF).alias("est_count"), "confidence")


