import corpus_pipeline
from contestlab.llm import linededup
from tests.llm.cases import documents

ROWS = [(1, "one long line"), (2, "one long line"), (3, "two\nlines"), (4, "two\nlines"), (5, "two\nlines\nmore"), (6, " \t"), (7, " \t"), (8, None), (None, "one long line"), (9, "two")]


def test_later_copies_of_short_texts_are_cut(spark):
    docs = documents(spark, [(*r, "en", "s") for r in ROWS])
    got = {r.doc_id: (r.text, r.n_lines, r.n_cut) for r in linededup.deduplicate_lines(docs, counts=("n_lines", "n_cut"), short=True).collect()}
    assert got == {1: ("one long line", 1, 0), 2: ("", 1, 1), 3: ("two\nlines", 2, 0), 4: ("", 2, 2), 5: ("two\nlines\nmore", 3, 0), 6: (" \t", 1, 0), 7: (" \t", 1, 0), 8: (None, 0, 0), None: ("", 1, 1), 9: ("two", 1, 0)}
    stage = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.cut_repeated_lines(spark, docs, "").collect()}
    assert stage[2] == ("", 0) and stage[1] == ("one long line", 13)
