import time

from contestlab.llm import linededup
from tests.llm.cases import HARD, documents


def brute(rows):
    """Distinct (id, text), first occurrence by (id, text hash order is free): texts after cutting, for unique ids."""
    seen, out = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for d, text in order:
        lines = [] if text is None else text.split("\n")
        cut = set()
        for i in range(len(lines) - 2):
            win = tuple(lines[i : i + 3])
            if "".join(win).strip(" \t\n\r\x0b\x0c") == "":
                continue
            if seen.setdefault(win, (d, i)) != (d, i):
                cut |= {i, i + 1, i + 2}
        out[d] = (None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in cut), len(lines), len(cut))
    return out


def test_equals_brute_force(spark):
    texts = ["a\nb\nc\nd\ne", "x\nb\nc\nd\ny", "a\nb\nc", "q\nq\nq\nq\nq\nq", "p\n\n\n\n\nr", "b\nc\nd\ne\nf\nb\nc\nd", "one\ntwo", "", "\n\n\n\n", None, "long\n" * 3000]
    rows = list(enumerate(texts, 10)) + [(None, "a\nb\nc\nzz")]
    docs = documents(spark, [(*r, "en", "s") for r in rows])
    got = linededup.deduplicate_lines(docs, counts=("n_lines", "n_cut"))
    assert got.columns == [*docs.columns, "n_lines", "n_cut"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_cut) for r in got.collect()} == brute(rows)


def test_hard_rows(spark):
    docs = documents(spark, HARD)
    got = linededup.deduplicate_lines(docs).collect()
    same = [r for r in got if r.doc_id == 6]
    assert len(got) == len(HARD) and len(same) == 2 and all(r.text == HARD[5][1] for r in same)
    assert [r.text for r in got if r.doc_id is None and r.text is not None] == [""]
    assert linededup.deduplicate_lines(docs.limit(0)).count() == 0


def test_work_is_linear_in_lines(spark):
    lines = [f"line {i}" for i in range(300_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new", *lines[1000:], "last"])), (3, "\n".join(f"{x} {i % 3}" if i % 7 == 0 else x for i, x in enumerate(lines)))]
    docs = documents(spark, [(*r, "en", "s") for r in rows])
    began = time.monotonic()
    got = {r.doc_id: r for r in linededup.deduplicate_lines(docs, counts=("n_lines", "n_cut")).collect()}
    assert time.monotonic() - began < 60
    assert got[1].n_cut == 0 and got[2].text == "new\nlast" and got[2].n_cut == 299_000
    assert got[3].text == "\n".join(f"{x} {i % 3}" for i, x in enumerate(lines) if i % 7 == 0)
