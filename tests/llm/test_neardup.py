import random

import pytest

import corpus_pipeline
from contestlab.llm import neardup
from tests.llm.cases import HARD, documents


def sets_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute(rows):
    """doc_id to component, by all pairs of exact similarities."""
    sets, comp = [sets_of(t) for _, t in rows], [d for d, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if comp[i] != comp[j] and near(sets[i], sets[j]):
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    return dict(zip((d for d, _ in rows), comp, strict=True))


def corpus():
    """Chains of edits, so that groups reach beyond what is near their least text, and similarities on both sides of 0.8."""
    rng = random.Random(5)
    vocabulary, texts = [f"w{i}" for i in range(400)], []
    for i in range(200):
        if i % 4 and texts:
            words = rng.choice(texts[-12:]).split()
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 120, 200]))]
        texts.append(" ".join(words))
    return list(enumerate(texts + ["", " \n", "a b", "A  b", "a c"], 10))


@pytest.mark.parametrize("paired", [64, 1])
def test_groups_equal_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(neardup, "PAIRED", paired)
    rows = corpus()
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_groups(documents(spark, [(*r, "en", "s") for r in rows])).collect()}
    assert got == want and 50 < len(set(want.values())) < 190


def test_stage_keeps_one_of_each_group(spark):
    rows = corpus()
    docs = documents(spark, [(*r, "en", "s") for r in rows])
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(rows).values()))


def test_hard_rows(spark):
    docs = documents(spark, HARD)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 4, 5, 6, 7]
    assert neardup.near_groups(docs.limit(0)).count() == 0


def test_prefixes_meet_all_that_are_near(spark):
    """Random sets around the threshold: every near pair is among the pairs, whatever is common."""
    rng, texts = random.Random(11), []
    for i in range(400):
        words = rng.choice(texts).split() if texts and rng.random() < 0.85 else [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 20, 60]))]
        for _ in range(rng.randrange(0, 2)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
        texts.append(" ".join(words[: max(1, len(words) - rng.randrange(0, 6))]))
    texts = list(dict.fromkeys(texts))
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "key long, part long, text string")
    got = {(r.u, r.v) for r in neardup.prefix_pairs(rows).collect()}
    sets = [sets_of(t) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if near(sets[i], sets[j])}
    assert want <= got and len(want) > 50


def test_many_texts_of_one_template_are_not_paired(spark, monkeypatch):
    """Thousands of texts share most of their words and aren't near, but for a few."""
    rng = random.Random(3)
    template = [f"t{i}" for i in range(160)]
    rows = [(i, " ".join(template + [f"x{i}y{k}" for k in range(50)])) for i in range(5000)]
    rows += [(6000 + i, rows[i * 7][1].replace(f"x{i * 7}y25", "other")) for i in range(40)]
    rng.shuffle(rows)
    seen, plain = [], neardup.prefix_pairs
    monkeypatch.setattr(neardup, "prefix_pairs", lambda *a: (seen.append(neardup.materialize(plain(*a), "pairs")), seen[-1])[1])
    got = {r.doc_id: r.component_id for r in neardup.near_groups(documents(spark, [(*r, "en", "s") for r in rows])).collect()}
    want = {i: i for i, _ in rows} | {6000 + i: i * 7 for i in range(40)}
    assert got == want
    assert seen[0].count() < 5000
