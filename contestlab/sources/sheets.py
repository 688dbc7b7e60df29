"""Typed rows from the text of scanned documents: result sheets, sections of joint documents, roll counters.

Input is page text and ruled tables as DataFrames, in composed Unicode. Rolls hold people's data, so they are counted inside the
row that holds the text: no shuffle, file or result ever sees a line of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.functions import text as T

# Fixed values.
STATION_HEADER = (r"serial\s*(?:no|number)", r"polling\s*station", r"मतदान\s*केन्?द्र", r"क्रम\s*सं")
TAIL = {
    "total_valid": (r"total\s*(?:number\s*)?of\s*valid\s*votes", r"कुल\s*वैध\s*मत", r"वैध\s*मतों?\s*की"),
    "rejected": (r"(?:no|number)\.?\s*of\s*rejected\s*votes", r"अस्वीकृत\s*मत", r"रद्द\s*मत"),
    "nota": (r"\bnota\b", r"none\s*of\s*the\s*above", r"नोटा", r"इनमें\s*से\s*कोई\s*नहीं"),
    "total": (r"^total$", r"^कुल$", r"कुल\s*योग"),
    "tendered": (r"tendered\s*votes", r"निविदत्त\s*मत"),
}
TEXT_ROW = r"^\s*(\d{1,3})\s+((?:\d{1,6}\s+)+)(\d{1,7})\s*$"
PERSON_ID = r"\b(?:[A-Z]{3}\d{7}|[A-Z]{2}/\d{2}/\d{3}/\d{6})\b"
RELATIVE = r"(?i)(?:पिता|पति|माता|Father|Husband|Mother)\s*(?:का\s*)?(?:नाम|Name)\s*[:：].*?(?=(?:मकान|House|आयु|Age|लिंग|Gender|क्रम)|$)"
NAME = r"(?i)(?:नाम|Name)\s*[:：]\s*(.+?)(?=\s{2,}|(?:पिता|पति|माता|मकान|House|Father|Husband|Age|आयु|लिंग|Gender)|$)"
AGE = r"(?i)(?:आयु|उम्र|Age)\s*[:：]?\s*(\d{1,3})"
GENDER = r"(?i)(?:लिंग|Gender)\s*[:：]?\s*(पुरुष|महिला|अन्य|Male|Female|Other|M|F|O)(?![\wऀ-ॿ])"
STATION_NUMBER = r"(?i)(?:मतदान\s*केन्?द्र\s*(?:सं|संख्या)|Polling\s*Station\s*(?:No|Number))\s*[.:：]?\s*(\d{1,3})"
PART_NUMBER = r"(?i)(?:भाग\s*संख्या|Part\s*(?:No|Number))\s*[.:：]?\s*(\d{1,4})"
SECTIONS = {
    "additions": (r"परिवर्धन", r"ADDITION", r"नये?\s*मतदाता", r"SUPPLEMENT.*ADDITION"),
    "deletions": (r"विलोपन", r"DELETION", r"अपमार्जन", r"हटाये?\s*गये"),
    "modifications": (r"संशोधन", r"MODIFICATION", r"CORRECTION"),
}
REASONS = {
    "death": (r"मृत", r"मृत्यु", r"DEAD", r"DEATH", r"EXPIRED", r"\bE\b"),
    "shifted": (r"स्थाना?न्?तरित", r"स्थानांतरण", r"SHIFT", r"SHIFTED", r"\bS\b"),
}
MALE, FEMALE = ("पुरुष", "male", "m"), ("महिला", "female", "f")
SEGMENT_HEADERS = (
    r"(?i)(?:assembly|vidhan)\s*(?:segment|constituency|sabha)?\s*(?:no\.?|number)?\s*[-:]?\s*(\d{1,3})\s*[-:.]?\s*([^\d\n]{2,60})",
    r"(?i)\b(\d{1,3})\s*[-:.]\s*([^\d\n]{2,60}?)\s*[(\[]?\s*(?:assembly|vidhan)\s*(?:segment|sabha)",
    r"(?:विधान\s*सभा)\s*(?:क्षेत्र)?\s*(?:सं\.?)?\s*[-:]?\s*(\d{1,3})\s*[-:.]?\s*([^\d\n]{2,60})",
    r"\b(\d{1,3})\s*[-:.]\s*([^\d\n]{2,60}?)\s*विधान\s*सभा",
)
HEADER_LINES, MOST_SEGMENTS = 8, 300
BANDS = [name for _, name in reversed(T.AGE_BANDS)]


def _any(patterns) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def _plain(cell: Column) -> Column:
    return T.normalize(cell, compose=False)


def _label(cell: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, patterns in reversed(TAIL.items()):
        out = F.when(F.lower(cell).rlike(_any(patterns)), name).otherwise(out)
    return out


def sheet_rows(pages: DataFrame) -> DataFrame:
    """doc, page_no, station, columns, votes, tail (map), method: rows of result sheets (doc, page_no, text, tables).

    A document's header is its first table row with two candidates and one total at least; what lies between
    the station's column and the first total is candidates. Short rows are padded with 0. Pages without any
    table row are read line by line under the same header; stations that are known already are left out.
    """
    table = pages.select("doc", "page_no", F.posexplode("tables").alias("t", "table")).select("doc", "page_no", "t", F.posexplode("table").alias("r", "row"))
    cells = table.select("doc", F.struct("page_no", "t", "r").alias("at"), F.transform("row", _plain).alias("cells"))
    station = F.array_position(F.transform("cells", lambda c: F.lower(c).rlike(_any(STATION_HEADER))), True)
    cells = cells.withColumn("ps", F.greatest(station, F.lit(1)).cast("int"))
    labels = F.transform("cells", lambda c, i: F.when(i >= F.col("ps"), _label(c)))
    cells = cells.withColumn("found", labels)
    # each total names its first column only
    first_of = F.transform("found", lambda x, i: F.when(x.isNotNull() & (F.array_position(F.col("found"), x) == i + 1), x))
    cells = cells.withColumn("found", first_of)
    tail_at = F.array_min(F.filter(F.transform("found", lambda x, i: F.when(x.isNotNull(), i + 1)), lambda i: i.isNotNull()))
    cells = cells.withColumn("tail_at", tail_at.cast("int"))
    names = F.slice("cells", F.col("ps") + 1, F.greatest(F.col("tail_at") - F.col("ps") - 1, F.lit(0)))
    heads = cells.filter(F.col("tail_at").isNotNull() & (F.col("tail_at") - F.col("ps") >= 3))
    heads = heads.groupBy("doc").agg(F.min_by(F.struct("at", "ps", names.alias("columns"), F.array_compact("found").alias("tail")), "at").alias("h"))
    rows = cells.select("doc", "at", "cells").join(heads, "doc").filter(F.col("at") > F.col("h.at"))
    body = F.slice("cells", F.col("h.ps") + 1, 10_000)
    rows = rows.select("doc", F.col("at.page_no").alias("page_no"), "h", T.parse_int(F.try_element_at("cells", F.col("h.ps"))).alias("station"), F.transform(body, T.parse_int).alias("numbers"))
    rows = rows.filter((F.col("station") > 0) & (F.col("station") < 1000) & (F.size(F.array_compact("numbers")) >= 2))
    n = F.size("h.columns")

    def typed(df: DataFrame, method: str) -> DataFrame:
        votes = F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.try_element_at("numbers", i), F.lit(0)))
        tail = F.map_from_arrays("h.tail", F.transform("h.tail", lambda _, i: F.try_element_at(F.col("numbers"), n + i + 1)))
        return df.select("doc", "page_no", "station", F.col("h.columns").alias("columns"), votes.alias("votes"), tail.alias("tail"), F.lit(method).alias("method"))

    ruled = typed(rows, "table")
    bare = pages.join(ruled.select("doc", "page_no").distinct(), ["doc", "page_no"], "left_anti").join(heads, "doc")
    line = F.explode(F.transform(F.split("text", "\n"), lambda x: T.normalize_digits(_plain(x)))).alias("line")
    lines = bare.select("doc", "page_no", "h", line).filter(F.col("line").rlike(TEXT_ROW))
    all_numbers = F.transform(F.regexp_extract_all("line", F.lit(r"(\d+)"), 1), lambda x: x.cast("long"))
    lines = lines.select("doc", "page_no", "h", all_numbers[0].alias("station"), F.slice(all_numbers, 2, 10_000).alias("numbers")).filter(F.size("numbers") >= n)
    lines = typed(lines, "text").join(ruled.select("doc", "station").distinct(), ["doc", "station"], "left_anti")
    return ruled.unionByName(lines)


def sheet_votes(rows: DataFrame) -> DataFrame:
    """Long form: doc, station, contestant, votes; NOTA is a contestant's row like any other."""
    named = rows.select("doc", "station", F.explode(F.arrays_zip("columns", "votes")).alias("p")).select("doc", "station", F.col("p.columns").alias("contestant"), F.col("p.votes").alias("votes"))
    nota = rows.select("doc", "station", F.lit("NOTA").alias("contestant"), F.try_element_at("tail", F.lit("nota")).alias("votes")).filter("votes is not null")
    return named.unionByName(nota)


def sheet_errors(rows: DataFrame) -> DataFrame:
    """doc, station, kind, detail: stations that appear twice, sums that differ from the printed total, negative votes, numbers left out."""
    total = F.aggregate("votes", F.lit(0).cast("long"), lambda s, v: s + v) + F.coalesce(F.try_element_at("tail", F.lit("nota")), F.lit(0))
    printed = F.try_element_at("tail", F.lit("total_valid"))
    row = lambda df, kind, detail: df.select("doc", "station", F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))
    twice = rows.groupBy("doc", "station").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    span = rows.groupBy("doc").agg(F.min("station").alias("a"), F.max("station").alias("b"))
    every = span.select("doc", F.explode(F.sequence("a", "b")).alias("station"))
    gaps = every.join(rows.select("doc", "station"), ["doc", "station"], "left_anti")
    parts = [row(twice, "twice", F.col("n")), row(rows.filter(printed.isNotNull() & (printed != total)), "sum", total - printed), row(rows.filter(F.exists("votes", lambda v: v < 0)), "negative", F.lit(None)), row(gaps, "missing", F.lit(None))]
    return reduce(DataFrame.unionByName, parts)


def segment_header(text: Column) -> Column:
    """struct(number, name) if the first lines of a page open a section."""
    head = F.array_join(F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\r?\n"), 1, HEADER_LINES), lambda x: T.normalize_digits(_plain(x))), "\n")
    out = F.lit(None).cast("struct<number:bigint,name:string>")
    for pattern in reversed(SEGMENT_HEADERS):
        number = F.regexp_extract(head, pattern, 1).try_cast("long")
        name = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract(head, pattern, 2), r"\s+", " ")), r"^[ \-:.()\[\]]+|[ \-:.()\[\]]+$", "")
        out = F.when(number.between(1, MOST_SEGMENTS) & (name != ""), F.struct(number.alias("number"), name.alias("name"))).otherwise(out)
    return out


def segments(pages: DataFrame) -> DataFrame:
    """pages (doc, page_no, text) with segment, its name and section, counted from 1; pages before the first header go."""
    w = Window.partitionBy("doc").orderBy("page_no")
    rows = pages.withColumn("h", segment_header(F.col("text")))
    rows = rows.withColumns({"segment": F.last("h.number", ignorenulls=True).over(w), "name": F.last("h.name", ignorenulls=True).over(w)})
    new = F.coalesce(F.col("segment") != F.lag("segment").over(w), F.col("segment").isNotNull())
    rows = rows.withColumn("new", new).withColumn("section", F.sum(F.col("new").cast("int")).over(w))
    return rows.filter("segment is not null").drop("h", "new")


def one_segment(pages: DataFrame, number: int) -> DataFrame:
    """The pages of one segment; an error if a document has none of it, or has it in more than one place."""
    rows = segments(pages).filter(F.col("segment") == number)
    counts = pages.select("doc").distinct().join(rows.groupBy("doc").agg(F.countDistinct("section").alias("n")), "doc", "left").filter("n is null or n != 1").limit(5).collect()
    if counts:
        raise ValueError(f"segment {number} is not in one place of " + ", ".join(f"{r['doc']} ({r['n'] or 0})" for r in counts))
    return rows


def _lines(text: Column) -> Column:
    return F.split(T.normalize_digits(T.normalize_block(text)), "\n")


def _number(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("long")


def _values(line: Column, both: Column, n: Column, pattern: str, relatives: bool = False) -> Column:
    """The first n values of a line, which may go on in the next one."""
    take = lambda x: F.regexp_extract_all(F.regexp_replace(x, RELATIVE, " ") if relatives else x, F.lit(pattern), 1)
    own = take(line)
    return F.slice(F.when(F.size(own) < n, take(both)).otherwise(own), 1, F.greatest(n, F.lit(0)))


def _entries(lines: str) -> Column:
    """Per line: n, genders, ages, names. Exists only inside an expression."""

    def entry(line, i):
        both = F.concat_ws(" ", line, F.try_element_at(F.col(lines), i + 2))
        n = F.regexp_count(line, F.lit(PERSON_ID))
        return F.struct(n.alias("n"), _values(line, both, n, GENDER).alias("g"), _values(line, both, n, AGE).alias("a"), _values(line, both, n, NAME, True).alias("s"), line.alias("line"), both.alias("both"))

    return F.transform(lines, entry)


def _count(values: Column, test) -> Column:
    return F.size(F.filter(values, test)).cast("long")


def _same(name: str):
    return lambda x: x == name


def _genders(g: Column) -> tuple[Column, Column]:
    return _count(g, lambda x: F.lower(x).isin(*MALE)), _count(g, lambda x: F.lower(x).isin(*FEMALE))


def roll_counts(rolls: DataFrame) -> DataFrame:
    """One row of counters for each full roll (doc, text): electors, genders, age bands, and surnames with how often each occurs."""
    rows = rolls.select("doc", _lines(F.col("text")).alias("lines"), T.normalize_digits(T.normalize_block(F.col("text"))).alias("t"))
    rows = rows.select("doc", _number(F.col("t"), STATION_NUMBER).alias("station"), _number(F.col("t"), PART_NUMBER).alias("part"), F.filter(_entries("lines"), lambda e: e["n"] > 0).alias("e"))
    flat = lambda c: F.flatten(F.transform("e", lambda e: e[c]))
    electors = F.aggregate("e", F.lit(0).cast("long"), lambda s, e: s + e["n"])
    male, female = _genders(flat("g"))
    age = F.transform(flat("a"), lambda x: x.cast("int"))
    last = F.filter(F.transform(flat("s"), lambda x: F.coalesce(F.element_at(F.split(F.trim(x), r"\s+"), -1), F.lit(""))), lambda x: x != "")
    histogram = F.map_from_entries(F.transform(F.array_distinct(last), lambda x: F.struct(x, _count(last, lambda y: y == x))))
    band = F.transform(age, lambda x: T.age_band(x))
    bands = [F.size(F.filter(band, _same(name))).cast("long").alias(f"age_{name}") for name in BANDS]
    return rows.select("doc", "station", "part", electors.alias("electors"), male.alias("male"), female.alias("female"), (electors - male - female).alias("other"), *bands, histogram.alias("surnames"))


def supplement_counts(rolls: DataFrame) -> DataFrame:
    """One row of counters for each supplement (doc, text): additions, deletions by reason, modifications, by the heading above each entry."""
    rows = rolls.select("doc", _lines(F.col("text")).alias("lines"), T.normalize_digits(T.normalize_block(F.col("text"))).alias("t"))
    rows = rows.select("doc", _number(F.col("t"), STATION_NUMBER).alias("station"), _number(F.col("t"), PART_NUMBER).alias("part"), _entries("lines").alias("e"))

    def heading(line):
        out = F.lit(None).cast("string")
        for name, patterns in reversed(SECTIONS.items()):
            out = F.when(line.rlike(_any(patterns)), name).otherwise(out)
        return out

    names = ["additions", "deletions", "modifications", "add_18_19", "add_female", "add_male", "del_death", "del_shifted"]
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(None).cast("string").alias("section"), *(zero.alias(c) for c in names))

    def step(s, e):
        head = heading(e["line"])
        here = lambda section: head.isNull() & s["section"].eqNullSafe(F.lit(section))
        n, (male, female) = e["n"].cast("long"), _genders(e["g"])
        death, shifted = e["both"].rlike(_any(REASONS["death"])), e["both"].rlike(_any(REASONS["shifted"]))
        more = {
            "additions": F.when(here("additions"), n),
            "deletions": F.when(here("deletions"), n),
            "modifications": F.when(here("modifications"), n),
            "add_18_19": F.when(here("additions"), _count(e["a"], lambda x: x.cast("int").between(18, 19))),
            "add_female": F.when(here("additions"), female),
            "add_male": F.when(here("additions"), male),
            "del_death": F.when(here("deletions") & death, n),
            "del_shifted": F.when(here("deletions") & ~death & shifted, n),
        }
        return F.struct(F.coalesce(head, s["section"]).alias("section"), *((s[c] + F.coalesce(more[c], zero)).alias(c) for c in names))

    rows = rows.select("doc", "station", "part", F.aggregate("e", start, step).alias("s"))
    return rows.select("doc", "station", "part", *(F.col(f"s.{c}") for c in names))
