"""Line deduplication by overlapping windows of three lines.

Each document is cut at newlines; every three consecutive lines are one window, hashed to 128 bits. A window
that occurs more than once in the corpus keeps its first occurrence, by (doc_id, position); the lines of all
later occurrences are covered. Covered positions of overlapping windows merge, and the covered lines go.

Each line is split and hashed once and the covered lines are cut as runs, so the work is linear in a text's lines.
Only hashes and positions are shuffled to find the repeats; the first occurrence of each window is found by
a pre-aggregated minimum, and the table of repeated windows is joined back without a hint, so a window that
is in a third of the documents is split by the adaptive join.

Defined cases: a null text stays null with 0 lines; windows of white space only are left alone. A text of fewer than
three lines is left alone too, or with short is one window of its own. A null doc_id sorts last. Repeated rows (same id and text) count as one document
and all get the same result. If all lines are covered the text is empty, not null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

WINDOW = 3
LAST = (1 << 63) - 1


def _lines(text) -> F.Column:
    return F.split(text, "\n", -1)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """k_id, k_text, pos: each later occurrence of a window, by the keys of its document and its first line."""
    text = F.col(text_col).cast("string")
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("k_id"), F.xxhash64(text).alias("k_text"), _lines(text).alias("lines"))
    rows = rows.filter(F.size("lines") >= (1 if short else WINDOW))
    # each line is hashed once, a window is the hash of its lines' hashes; lines beyond the end of a short text are null and not hashed
    line = lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), x.rlike(r"[^\x20\x09-\x0D]").alias("ink"))
    of = lambda marks, i, name: [F.get(marks, i + j)[name] for j in range(WINDOW)]
    window = lambda marks, i: F.struct(i.alias("pos"), F.xxhash64(*of(marks, i, "h1")).alias("h1"), F.xxhash64(*of(marks, i, "h2")).alias("h2"), F.coalesce(F.greatest(*of(marks, i, "ink")), F.lit(False)).alias("ink"))
    # bound as a lambda's variable, the marks of a text are worked out once and not for each window
    windows = F.transform(F.array(F.transform("lines", line)), lambda marks: F.transform(F.sequence(F.lit(0), F.greatest(F.size(marks) - WINDOW, F.lit(0))), lambda i: window(marks, i)))
    spots = rows.select("k_id", "k_text", F.explode(windows[0]).alias("w"))
    spots = spots.select("k_id", "k_text", "w.*").filter("ink").drop("ink")
    place = F.struct("k_id", "k_text", "pos")
    twice = spots.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("h1", "h2", "first")
    return spots.join(twice, ["h1", "h2"]).filter(place > F.col("first")).select("k_id", "k_text", "pos")


def _without(lines: F.Column, cut: F.Column) -> F.Column:
    """The lines at other positions than cut (sorted), as one text: the runs between them, each taken as a slice."""
    from_, to = lambda x, i: F.coalesce(F.get(x["cut"], i - 1) + 1, F.lit(0)), lambda x, i: F.coalesce(F.get(x["cut"], i), F.size(x["lines"]))
    runs = lambda x: F.transform(F.sequence(F.lit(0), F.size(x["cut"])), lambda i: F.slice(x["lines"], from_(x, i) + 1, F.greatest(to(x, i) - from_(x, i), F.lit(0))))
    return F.array_join(F.flatten(F.transform(F.array(F.struct(lines.alias("lines"), cut.alias("cut"))), runs)[0]), "\n")


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None, short: bool = False) -> DataFrame:
    """docs with the covered lines cut out of text_col; counts: names of two more columns, lines before and lines cut; short: also later copies of texts of one or two lines."""
    names, text = docs.columns, F.col(text_col).cast("string")
    covered = repeated_windows(docs, id_col, text_col, short).select("k_id", "k_text", F.explode(F.sequence(F.col("pos"), F.col("pos") + WINDOW - 1)).alias("pos"))
    # a document's own covered positions: no more than it has lines
    covered = covered.groupBy("k_id", "k_text").agg(F.array_sort(F.collect_set("pos")).alias("cut"))
    k_id, k_text, cut = (free_name(docs, x) for x in ("k_id", "k_text", "cut"))
    rows = docs.withColumns({k_id: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), k_text: F.xxhash64(text)})
    covered = covered.select(F.col("k_id").alias(k_id), F.col("k_text").alias(k_text), F.col("cut").alias(cut))
    rows = rows.join(covered, [k_id, k_text], "left")
    out = {n: F.when(F.col(cut).isNull(), text).otherwise(_without(_lines(text), F.col(cut))) if n == text_col else F.col(n) for n in names}
    if counts:
        out |= {counts[0]: F.when(text.isNull(), 0).otherwise(F.size(_lines(text))), counts[1]: F.when(F.col(cut).isNull(), 0).otherwise(F.least(F.size(cut), F.size(_lines(text))))}
    return rows.select(*(c.alias(n) for n, c in out.items()))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate_lines(docs, counts=("n_lines", "n_cut"))


OP4_SQL = f"""
WITH d AS (SELECT coalesce(CAST(doc_id AS BIGINT), {LAST}) AS k, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT k, text, lines, CAST(unnest(range(0, greatest(len(lines) - {WINDOW - 1}, 0))) AS INT) AS pos FROM (SELECT DISTINCT k, text, lines FROM d WHERE text IS NOT NULL)),
spots AS (SELECT k, text, pos, array_to_string(lines[pos + 1:pos + {WINDOW}], chr(10)) AS win FROM w),
ranked AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY k, text, pos) AS rn FROM spots WHERE regexp_matches(win, '[^\\x20\\x09-\\x0D]')),
covered AS (SELECT k, text, list(DISTINCT p) AS cut FROM (SELECT k, text, unnest(range(pos, pos + {WINDOW})) AS p FROM ranked WHERE rn > 1) GROUP BY 1, 2)
SELECT d.doc_id, CASE WHEN cut IS NULL THEN d.text ELSE array_to_string(list_filter(lines, lambda x, i: NOT list_contains(cut, i - 1)), chr(10)) END AS text,
CAST(coalesce(len(lines), 0) AS INT) AS n_lines, CAST(coalesce(len(cut), 0) AS INT) AS n_cut
FROM d LEFT JOIN covered c ON d.k = c.k AND d.text = c.text"""

QUERIES = {"op4_line_windows": op4}
SQL = {"op4_line_windows": OP4_SQL}
