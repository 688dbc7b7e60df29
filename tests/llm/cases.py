"""Rows that every operator must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, fp string, score string, key string, p string"


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); further columns carry names that operators use inside."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "a", "b", "c", "d", "e") for r in rows], DOCS)


HARD = [
    (1, None, "en", "s"),
    (2, "", "en", "s"),
    (3, " \t\n", None, None),
    (4, "one", "en", ""),
    (5, "word " * 60_000, "en", "s"),
    (6, "Same text here\nand there\nand more", "en", "s"),
    (6, "Same text here\nand there\nand more", "en", "s"),
    (None, "Same text here\nand there\nand more", "en", None),
    (None, None, None, None),
    (7, "ÄÖ ü ß 日本 \u0301 \x00 x", "de", "t"),
]
