import pytest
from pyspark.sql import functions as F

from contestlab.llm import mixing
from tests.llm.cases import HARD, documents


def test_raking_meets_given_marginals(spark):
    cells = spark.createDataFrame([("a", "en", "x", 100.0), ("a", "de", "x", 50.0), ("b", "en", "y", 10.0), ("b", "de", "y", 30.0), ("b", "de", "x", 5.0), ("c", "en", "x", 0.0)], "source string, lang string, topic string, w double")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"x": 0.7, "y": 0.3}}
    rows = cells.join(mixing.rake(cells, targets, rounds=24), ["source", "lang", "topic"]).collect()
    mass = {(r.source, r.lang, r.topic): r.w * r.p for r in rows}
    for i, m in enumerate(mixing.MARGINALS):
        for label, share in targets[m].items():
            assert sum(v for k, v in mass.items() if k[i] == label) / sum(mass.values()) == pytest.approx(share, abs=1e-4)
    assert max(r.p for r in rows) == 1.0


def test_draws_follow_probabilities(spark):
    docs = documents(spark, [(i, "w " * (1 + i % 5), "en" if i % 3 else "de", "hot" if i % 2 else f"s{i % 10}") for i in range(20000)])
    kept = mixing.sample_to_targets(docs, {"source": {"hot": 0.2, "s0": 0.2, "s2": 0.2, "s4": 0.2, "s6": 0.2}})
    tokens = {r[0]: r[1] for r in kept.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " ")))).collect()}
    assert "s8" not in tokens and tokens["hot"] / sum(tokens.values()) == pytest.approx(0.2, abs=0.03)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in mixing.sample_to_targets(docs.orderBy(F.desc("doc_id")), {"source": {"hot": 0.2, "s0": 0.2, "s2": 0.2, "s4": 0.2, "s6": 0.2}}).collect())


def test_hard_rows(spark):
    docs = documents(spark, HARD)
    assert mixing.sample_to_targets(docs).count() <= len(HARD)
    assert mixing.sample_to_targets(docs, details=True).columns == ["doc_id", "source", "lang", "topic", "n_tokens", "p_millionths"]
    assert mixing.sample_to_targets(docs.limit(0)).count() == 0
    blank = documents(spark, HARD[:3])
    assert mixing.sample_to_targets(blank).count() == 3


def test_very_long_texts_and_equal_rows(spark):
    """A text of a million words weighs as many tokens; equal ids draw alike, also where all draws are equal."""
    rows = [(1, "word " * 1_000_000, "en", "s")] + [(2, "a b", "en", "s")] * 30 + [(i, "a b", "en", "s") for i in range(10, 40)]
    docs = documents(spark, rows)
    all_rows = mixing.sample_to_targets(docs, details=True, keep=1.0).collect()
    assert sorted(r.n_tokens for r in all_rows)[-1] == 1_000_000 and len(all_rows) == len(rows)
    some = [r.doc_id for r in mixing.sample_to_targets(docs, keep=0.5).collect()]
    assert some.count(2) in (0, 30)
