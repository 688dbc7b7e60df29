import pytest

from contestlab.llm import urlfilter

URLS = [
    (1, "http://Blog.Example.ORG/es/1?x#y", "blog.example.org", "/es/1", "example.org/es/", "block"),
    (2, "https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    (3, "https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    (4, "x://a.com/fr/?q", "a.com", "/fr/", "com/fr/", "allow"),
    (5, "x://a.com/de/z", "a.com", "/de/z", "com/de/", "block"),
    (6, "x://org", "org", "", None, "allow"),
    (7, "x://a.org?u=/es/", "a.org", "", None, "allow"),
    (8, "no scheme", "", "", None, "allow"),
    (9, None, "", "", None, "allow"),
    (10, "", "", "", None, "allow"),
    (11, "a://b://c/d", "b:", "//c/d", None, "allow"),
    (12, "x://a.com/de", "a.com", "/de", None, "allow"),
    (None, "x://ÄB.net/P", "Äb.net", "/P", None, "allow"),
]
PAGES, LABELS = "page_id long, url string, html string, host string, n long, a string", "doc_id long, quality int, toxic int, host string"


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "h", "zz", 1, "q") for i, u, *_ in URLS], PAGES)
    got = urlfilter.judge_pages(pages, spark.createDataFrame([], LABELS)).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(((i, *rest) for i, _, *rest in URLS), key=str)
    assert urlfilter.judge_pages(pages.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    pages, labels = [], []
    for i in range(600):
        host = ["good.net", "bad.net", "a.mixed.net", "one.co.uk"][i % 4]
        pages.append((i, f"http://{host}/{i}", "h", "x", 1, "q"))
        bad = host == "bad.net" and i % 12 != 1
        labels.append((i, None if i % 50 == 49 else int(not bad), 0, "y"))
    pages += [(1000, "http://new.bad.net/", "h", "x", 1, "q"), (1001, "http://unseen.example/", "h", "x", 1, "q")]
    p, q = spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)
    by_host = {r.host: r for r in urlfilter.host_reputation(p, q).collect()}
    rate = {h: r.a / (r.a + r.b) for h, r in by_host.items()}
    raw = by_host["bad.net"].n_bad / by_host["bad.net"].n_labelled
    assert 0.3 < rate["bad.net"] < raw and rate["good.net"] < 0.1
    assert rate["good.net"] < rate["unseen.example"] < rate["bad.net"]
    verdicts = {r.host: r.verdict for r in urlfilter.judge_pages(p, q).collect()}
    assert verdicts["bad.net"] == "block" and verdicts["good.net"] == verdicts["one.co.uk"] == "allow"


@pytest.mark.parametrize(("host", "want"), [("a.b.co.uk", ("b.co.uk", "co.uk")), ("x.org", ("x.org", "org")), ("org", ("org", "org")), ("", ("", ""))])
def test_parents(spark, host, want):
    df = spark.createDataFrame([(host,)], "h string")
    assert tuple(df.select(*urlfilter._parents(df["h"])).first()) == want


def test_equal_bounds_and_very_long_urls(spark):
    """Hosts of equal counts get equal verdicts, whatever their order; a path of a megabyte is judged whole."""
    pages = [(i, f"http://{'ab'[i % 2]}{i % 10}.twin.net/{i}", "h", "x", 1, "q") for i in range(400)]
    labels = [(i, int(i % 10 >= 5), 0, "y") for i in range(400)]
    long = "http://Example.org/" + "es/" * 400_000
    pages += [(1000, long, "h", "x", 1, "q"), (1001, long.replace("/es/", "/xs/", 1), "h", "x", 1, "q"), (1002, "http://" + "a." * 100_000 + "com/fr/", "h", "x", 1, "q")]
    df, marks = spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)
    got = {r.page_id: r for r in urlfilter.judge_pages(df, marks).collect()}
    by_host = {}
    for r in got.values():
        by_host.setdefault(r.host, set()).add(r.verdict)
    assert all(len(v) == 1 for h, v in by_host.items() if h.endswith("twin.net"))
    bad = {h: v for h, v in by_host.items() if h[1:2].isdigit() and int(h[1]) < 5}
    assert len({tuple(v) for v in bad.values()}) == 1 and bad
    assert (got[1000].rule, got[1001].rule, got[1002].rule) == ("example.org/es/", "org/", "com/fr/") and len(got[1000].path) == 1_200_001
