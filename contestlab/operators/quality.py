"""Checks of inputs and views. Each gives rows that are wrong, and no rows if all is well; text that matches a
personal-data pattern is counted, never shown."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from contestlab.functions import metrics as M

#: Personal data. Fixed values.
PERSONAL = {"epic": r"\b[A-Z]{3}[0-9]{7}\b", "mobile": r"(?<![0-9])[6-9][0-9]{9}(?![0-9])", "aadhaar": r"(?<![0-9])[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}(?![0-9])"}
FORBIDDEN_COLUMNS = ("epic", "voter_name", "elector_name", "father", "house", "address")
LINK_TARGET = 90.0


def totals_differ(sums: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Published totals that the units' votes don't add up to; a total without any votes counts as 0."""
    own = sums.groupBy(*keys).agg(F.sum("votes").alias("computed"))
    rows = published.select(*keys, F.col("votes").alias("published")).join(own, keys, "left").withColumn("computed", F.coalesce("computed", F.lit(0)))
    return rows.filter(F.col("computed") != F.col("published"))


def rows_differ(votes: DataFrame, printed: DataFrame, keys: list[str]) -> DataFrame:
    """Cells whose votes, NOTA among them, don't add up to the printed total (keys, total_valid)."""
    own = votes.groupBy(*keys).agg(F.sum("votes").alias("computed"))
    rows = printed.filter(F.col("total_valid").isNotNull()).join(own, keys, "left").withColumn("computed", F.coalesce("computed", F.lit(0)))
    return rows.filter(F.col("computed") != F.col("total_valid"))


def orphans(votes: DataFrame, links: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Results that no link leads from, and the votes that every view would lose."""
    return votes.join(links.select(*keys), keys, "left_anti").groupBy(*by).agg(F.countDistinct(*keys).alias("unlinked"), F.sum("votes").alias("votes_lost"))


def link_quality(links: DataFrame, by: list[str], target: float = LINK_TARGET) -> DataFrame:
    """Lists of which too few links are sure."""
    rows = links.groupBy(*by).agg(F.count(F.lit(1)).alias("links"), F.sum((F.col("confidence") >= M.CONFIDENT).cast("long")).alias("sure"))
    return rows.withColumn("sure_pct", M.pct(F.col("sure"), F.col("links"), 1)).filter(F.col("sure_pct") < target)


def roll_gaps(snapshots: DataFrame, units: DataFrame) -> DataFrame:
    """By group and full roll: units of the roll before that are missing in it.

    The rolls of a group are few; they are numbered once, and each unit row then looks for its successor.
    """
    rows = snapshots.join(units.select("unit_id", "group_id"), "unit_id").select("group_id", "unit_id", "day")
    rolls = rows.select("group_id", "day").distinct()
    nxt = rolls.withColumn("next_day", F.lead("day").over(Window.partitionBy("group_id").orderBy("day"))).filter("next_day is not null")
    expected = rows.join(nxt, ["group_id", "day"]).select("group_id", "unit_id", F.col("next_day").alias("day"))
    return expected.join(rows, ["group_id", "unit_id", "day"], "left_anti").groupBy("group_id", "day").agg(F.count(F.lit(1)).alias("missing"))


def forbidden_columns(tables: Mapping[str, DataFrame]) -> list[tuple[str, str]]:
    """(table, column) that could hold a person's data."""
    return [(t, c) for t, df in tables.items() for c in df.columns if any(x in c.lower() for x in FORBIDDEN_COLUMNS)]


def personal_data(df: DataFrame, table: str, patterns: Mapping[str, str] = PERSONAL) -> DataFrame:
    """table, column, pattern, values, hits: what each text column holds of each pattern, in one pass."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    n = lambda c, p: F.coalesce(F.regexp_count(F.col(f"`{c}`"), F.lit(p)), F.lit(0))
    cells = [(c, name, p) for c in columns for name, p in patterns.items()]
    if not cells:
        return df.sparkSession.createDataFrame([], "table string, column string, pattern string, values long, hits long")
    sums = df.agg(*(F.struct(F.coalesce(F.sum((n(c, p) > 0).cast("long")), F.lit(0)).alias("values"), F.coalesce(F.sum(n(c, p)), F.lit(0)).cast("long").alias("hits")).alias(f"x{i}") for i, (c, _, p) in enumerate(cells)))
    flat = F.array(*(F.struct(F.lit(table).alias("table"), F.lit(c).alias("column"), F.lit(name).alias("pattern"), F.col(f"x{i}.values").alias("values"), F.col(f"x{i}.hits").alias("hits")) for i, (c, name, _) in enumerate(cells)))
    return sums.select(F.explode(flat).alias("r")).select("r.*").filter("hits > 0")


def screen(df: DataFrame, column: str, patterns: Mapping[str, str] = PERSONAL) -> tuple[DataFrame, DataFrame]:
    """Rows without personal data in a column, and for those with it only how many of each pattern."""
    found = F.coalesce(F.col(column).rlike("|".join(f"(?:{p})" for p in patterns.values())), F.lit(False))
    hits = df.filter(found).agg(*(F.sum(F.col(column).rlike(p).cast("long")).alias(name) for name, p in patterns.items()))
    return df.filter(~found), hits


def low_confidence(estimates: DataFrame, least: float = 0.4, most_pct: float = 50.0) -> DataFrame:
    """One row if too large a share of estimates is too unsure."""
    rows = estimates.agg(F.count(F.lit(1)).alias("estimates"), F.sum((F.col("confidence") < least).cast("long")).alias("unsure"))
    return rows.withColumn("unsure_pct", M.pct(F.col("unsure"), F.col("estimates"), 1)).filter(F.col("unsure_pct") >= most_pct)


def violations(df: DataFrame, rules: Mapping[str, Column], unique: list[str] | None = None) -> DataFrame:
    """rule, n: rows that break a rule (NULL passes), and keys that aren't unique."""
    sums = df.agg(*(F.coalesce(F.sum((~F.coalesce(test, F.lit(True))).cast("long")), F.lit(0)).alias(f"x{i}") for i, test in enumerate(rules.values())))
    out = sums.select(F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"x{i}").alias("n")) for i, name in enumerate(rules)))).alias("r")).select("r.*")
    if unique:
        twice = df.groupBy(*unique).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"unique {', '.join(unique)}").alias("rule"), "n")
        out = out.unionByName(twice)
    return out.filter("n > 0")


def missing_keys(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose foreign key leads nowhere."""
    return df.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def digest(df: DataFrame) -> DataFrame:
    """rows, digest: the same for the same rows in any order."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(df.columns)]
    h = F.xxhash64(*cells)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))
