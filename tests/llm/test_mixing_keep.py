import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contestlab.llm import mixing
from tests.llm.cases import HARD, documents


def tokens(df):
    return df.agg(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0]


def test_a_tiny_cell_does_not_shrink_the_corpus(spark):
    rows = [(i, "w " * (1 + i % 5), "en" if i % 3 else "de", "hot" if i % 2 else f"s{i % 10}") for i in range(6000)]
    docs, junk = documents(spark, rows), documents(spark, [*rows, (9999, "junk", "xx", "new")])
    shares = [tokens(corpus_pipeline.mix_sources(spark, d, "")) / tokens(d) for d in (docs, junk)]
    assert shares[0] == pytest.approx(corpus_pipeline.KEEP, abs=0.03) and shares[1] == pytest.approx(shares[0], abs=0.01)


def test_few_and_many_cells_rake_alike(spark):
    rng = random.Random(4)
    cells = spark.createDataFrame([(s, x, t, float(rng.randrange(50))) for s in "abcdefg" for x in ("en", "de", "") for t in "xy" if rng.random() < 0.8], "source string, lang string, topic string, w double")
    for keep in (None, 0.4):
        one, many = ({tuple(r)[:3]: r.p for r in mixing.rake(cells, rounds=4, keep=keep, few=few).collect()} for few in (1000, 0))
        assert one == pytest.approx(many, rel=1e-12) and len(one) == cells.count()


def test_full_cells_pass_their_share_to_the_others(spark):
    cells = spark.createDataFrame([("a", "en", "x", 100.0), ("a", "de", "x", 50.0), ("b", "en", "x", 10.0), ("b", "de", "x", 100.0), ("c", "en", "x", 1.0), ("d", "en", "x", 0.0)], "source string, lang string, topic string, w double")
    targets = {"source": {"a": 0.5, "b": 0.495, "c": 0.005}, "lang": {"en": 0.45, "de": 0.55}, "topic": {"x": 2.0}}
    rows = cells.join(mixing.rake(cells, targets, rounds=40, keep=0.5), ["source", "lang", "topic"]).collect()
    mass = {(r.source, r.lang): r.w * r.p for r in rows}
    assert all(0 < r.p <= 1 for r in rows) and sum(mass.values()) == pytest.approx(0.5 * 261, rel=1e-3)
    for i, m in enumerate(("source", "lang")):
        for label, share in targets[m].items():
            assert sum(v for k, v in mass.items() if k[i] == label) == pytest.approx(0.5 * 261 * share, rel=0.01)


def test_hard_rows(spark):
    docs = documents(spark, HARD)
    assert mixing.sample_to_targets(docs, keep=0.5).count() <= len(HARD)
    assert mixing.sample_to_targets(docs.limit(0), keep=0.5).count() == 0
    assert mixing.sample_to_targets(documents(spark, HARD[:3]), keep=0.5).count() == 3
