import random

import numpy as np
import pandas as pd

from contestlab.llm import toxicity
from tests.llm.cases import HARD, documents

LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=900):
    rng, rows, labels = random.Random(2), [], []
    plain = ["the", "green", "river", "walks", "under", "old", "stones", "and", "sings"]
    for i in range(n):
        words = [rng.choice(plain) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vile", "vilest", "grumbler"]) + rng.choice(["", "###", "."])
        rows.append((i, " ".join(words), "en" if i % 2 else "de", "s"))
        labels.append((i, 1, int(toxic), "z"))
    return rows, labels


def test_held_out_accuracy_and_inputs(spark):
    rows, labels = corpus()
    docs = documents(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
    got = toxicity.score(docs, model).toPandas()
    held = got[got.held_out]
    truth = held.doc_id.map({r[0]: r[2] for r in labels})
    assert 0.15 < len(held) / len(got) < 0.35
    assert ((held.score >= 0.3) == (held.predicted == 1)).all() and held.score.between(0, 1).all()
    assert (held.predicted == truth).mean() > 0.95
    other = documents(spark, [(i + 7, t, None, None) for i, t, _, _ in rows])
    again = toxicity.score(other, model).toPandas()
    pd.testing.assert_series_equal(got.sort_values("doc_id").score.reset_index(drop=True), again.sort_values("doc_id").score.reset_index(drop=True), atol=1e-5)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == (got.predicted == 0).sum()


def test_long_text_scores_as_in_one_piece(monkeypatch):
    rows, labels = corpus(300)
    model = toxicity.Model([r[1].encode() for r in rows], [x[2] for x in labels], [r[2] for r in rows], [r[0] for r in rows])
    text = " ".join(r[1] for r in rows[1:40]).encode()
    whole = model.score([text])[0]
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 50)
    assert abs(model.score([text])[0] - whole) < 1e-5


def brute_logit(model, text):
    """One text: each filter's largest answer over all places, padded with nothing."""
    net = model.net
    x = np.array([sum(net.emb[f] for f in toxicity.features(w)) for w in toxicity.words_of(text)] + [np.zeros(toxicity.DIM)] * 3)
    pooled = []
    for w, conv, bias in zip(toxicity.WIDTHS, net.conv, net.bias, strict=True):
        answers = [sum(x[i + j] @ conv[j] for j in range(w)) for i in range(len(x) - w + 1)]
        pooled.extend(np.maximum(np.max(answers, axis=0) + bias, 0))
    return float(np.array(pooled) @ net.out + net.base[0])


def test_logits_equal_brute_force_whatever_the_neighbours():
    rows, labels = corpus(300)
    model = toxicity.Model([r[1].encode() for r in rows], [x[2] for x in labels], [r[2] for r in rows], [r[0] for r in rows])
    texts = [r[1].encode() for r in rows[:40]] + [b"", None, b"### 12", b"vile"]
    logit, guess = model._raw(texts)
    assert np.allclose(logit, [brute_logit(model, t) for t in texts], atol=1e-4)
    alone = np.concatenate([model.score([t]) for t in texts])
    assert np.allclose(alone, model.score(texts), atol=1e-6) and np.allclose(model.score(texts[::-1])[::-1], alone, atol=1e-6)


def test_hard_rows(spark):
    docs = documents(spark, HARD)
    for labels in ([], [(4, 1, 1, "t"), (5, 1, None, "t"), (None, 1, 1, "t")], [(4, 1, 0, "t"), (6, 0, 1, "t"), (6, 0, 1, "t"), (7, 0, 0, "t")]):
        model = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
        assert toxicity.score(docs, model).count() == len(HARD)
    assert toxicity.score(docs.limit(0), model).count() == 0 == toxicity.keep_clean(docs.limit(0), model).count()
