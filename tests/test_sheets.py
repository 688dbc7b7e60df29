from contestlab.operators import quality
from contestlab.sources import sheets, tables

PAGES = "doc string, page_no int, text string, tables array<array<array<string>>>"
HEAD = ["Serial No. of Polling Station", "Asha Devi", "Ravi Kumar (ABC)", "Total of Valid Votes", "No. of Rejected Votes", "NOTA", "Total"]


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def pages(spark):
    ruled = [["junk"], HEAD, ["१", "1,000", "20", "1030", "3", "10", "1033"], ["2", "5"], ["x", "1", "2"], ["3", "7", "8", "16", "0", "1", "16"]]
    return spark.createDataFrame([("a", 1, "", [ruled]), ("a", 2, "4 10 20 35 1 5 36\n3 1 1 1 1 1 1\nnothing\n9 1", []), ("b", 1, "no header", [])], PAGES)


def test_sheets(spark):
    rows = sheets.sheet_rows(pages(spark))
    got = {(r.doc, r.station): (r.votes, r.tail, r.method) for r in rows.collect()}
    assert got == {
        ("a", 1): ([1000, 20], {"total_valid": 1030, "rejected": 3, "nota": 10, "total": 1033}, "table"),
        ("a", 3): ([7, 8], {"total_valid": 16, "rejected": 0, "nota": 1, "total": 16}, "table"),
        ("a", 4): ([10, 20], {"total_valid": 35, "rejected": 1, "nota": 5, "total": 36}, "text"),
    }
    assert found(sheets.sheet_errors(rows)) == [("a", 2, "missing", None)]
    assert ("a", 1, "NOTA", 10) in found(sheets.sheet_votes(rows)) and sheets.sheet_votes(rows).count() == 9


def test_sheet_errors(spark):
    rows = spark.createDataFrame([("a", 1, [5, -1], {"total_valid": 5}), ("a", 1, [1, 1], {"total_valid": 2})], "doc string, station long, votes array<long>, tail map<string, long>")
    assert {r.kind for r in sheets.sheet_errors(rows).collect()} == {"twice", "sum", "negative"}


def test_segments(spark):
    texts = ["preamble", "Assembly Segment No. 32 - Northtown\nrows", "more rows", "32 - Northtown (Assembly Segment)\nagain", "33-दक्षिण विधान सभा\nrows", "x\n" * 9 + "Assembly Segment 34 - Footer"]
    df = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "doc string, page_no int, text string")
    assert [(r.page_no, r.segment, r.section) for r in sheets.segments(df).orderBy("page_no").collect()] == [(2, 32, 1), (3, 32, 1), (4, 32, 1), (5, 33, 2), (6, 33, 2)]
    assert sheets.one_segment(df, 33).count() == 2
    try:
        sheets.one_segment(df, 99)
        raise AssertionError
    except ValueError as e:
        assert "d (0)" in str(e)


ROLL = """Polling Station No: 12  Part No: 4
1 ABC1234567 Name: Asha Devi  Father Name: Ram Yadav House 1 Age: 19 Gender: Female
2 ABC1234568 नाम: रवि कुमार  पिता का नाम: मोहन सिंह मकान 2 आयु: ४५ लिंग: पुरुष
3 ABC1234569
Name: Lila Devi  Age: 70 Gender: F
"""


def test_roll_counters_only(spark):
    df = sheets.roll_counts(spark.createDataFrame([("d", ROLL), ("e", None)], "doc string, text string"))
    rows = {r.doc: r.asDict() for r in df.collect()}
    r = rows["d"]
    assert (r["station"], r["part"], r["electors"], r["male"], r["female"], r["other"]) == (12, 4, 3, 1, 2, 0)
    assert (r["age_18-19"], r["age_40-49"], r["age_60+"]) == (1, 1, 1)
    assert r["surnames"] == {"Devi": 2, "कुमार": 1}  # never a relative's
    assert "ABC1234567" not in str(r) and "Asha" not in str(r) and "Yadav" not in str(r)
    assert rows["e"]["electors"] == 0 and "Exchange" not in df._jdf.queryExecution().toString()


def test_supplement_counters(spark):
    text = "ABC0000000 before any heading\nADDITIONS\n1 ABC1234567 Name: A B Age: 18 Gender: Female\nDELETIONS\n2 ABC1234568 Expired\n3 ABC1234569 shifted\n4 ABC1234560 other\n\nCORRECTION\n5 ABC1234561"
    (r,) = sheets.supplement_counts(spark.createDataFrame([("d", text)], "doc string, text string")).collect()
    assert tuple(r[3:]) == (1, 3, 1, 1, 1, 0, 1, 1)


def test_personal_data_is_counted_not_shown(spark):
    df = spark.createDataFrame([("call 9876543210", "x"), ("id ABC1234567 and ABC1234568", None), (None, "1234 5678 9012")], "a string, b string")
    assert found(quality.personal_data(df, "t")) == [("t", "a", "epic", 1, 2), ("t", "a", "mobile", 1, 1), ("t", "b", "aadhaar", 1, 1)]
    clean, hits = quality.screen(df, "a")
    assert clean.count() == 1 and hits.first().asDict() == {"epic": 1, "mobile": 1, "aadhaar": 0}
    assert quality.forbidden_columns({"t": spark.createDataFrame([], "Father_Name string, n int")}) == [("t", "Father_Name")]


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    assert quality.digest(a).first() == quality.digest(a.orderBy("i", ascending=False)).first() != quality.digest(a.limit(1)).first()


def test_tables(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("﻿id,name, ok ,x\n1, Ann ,yes,2.5\n,,,\n2,,no,bad\n", encoding="utf-8")
    df = tables.read_csv(spark, str(path), "id int, name string, ok boolean, x double, none string")
    assert found(df) == [(1, "Ann", True, 2.5, None), (2, None, False, None, None)]
    old = spark.createDataFrame([(1, "a", True), (2, "b", False)], "k int, v string, reviewed boolean")
    new = spark.createDataFrame([(1, "x", False), (2, "y", False), (2, "w", False), (3, "z", False)], "k int, v string, reviewed boolean")
    assert found(tables.upsert(old, new, ["k"])) == [(1, "x", False), (2, "y", False), (3, "z", False)]
    assert found(tables.upsert(old, new, ["k"], ~old.reviewed)) == [(1, "a", True), (2, "y", False), (3, "z", False)]
    assert found(tables.replace_keys(old, new.filter("k = 2"), ["k"])) == [(1, "a", True), (2, "w", False), (2, "y", False)]
    tables.store(old, str(tmp_path / "t"), ["k"])
    tables.store(new.filter("k = 3"), str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    tables.append(new.limit(1).drop("k"), str(tmp_path / "t" / "k=1"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    assert tables.swap(old.limit(1), str(tmp_path / "v")).count() == 1
    places = spark.createDataFrame([(1, 85.5, 24.1), (2, None, 24.0)], "id int, lon double, lat double")
    assert tables.write_geojson(places, str(tmp_path / "g")) == {"features": 2, "without_place": 1}
    assert any('"geometry":null' in r.value for r in spark.read.text(str(tmp_path / "g")).collect())
    tables.write_csv(places, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), "id int").count() == 2
