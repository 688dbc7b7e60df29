"""Training takes every labelled row, whatever its length, in pieces."""

import numpy as np

from contestlab.llm import toxicity
from tests.llm.cases import documents
from tests.llm.test_toxicity import LABELS, corpus


def test_long_labelled_texts_are_learnt_from(spark):
    rows, labels = corpus(200)
    filler = "the green river walks under old stones " * 5_200  # over 200,000 bytes
    rows += [(1000 + i, filler + "loathsome", "en", "s") for i in range(60)] + [(2000 + i, "the green loathsome stones", "en", "s") for i in range(20)]
    labels += [(1000 + i, 1, 1, "z") for i in range(60)]
    docs = documents(spark, rows)
    got = toxicity.score(docs.filter("doc_id >= 2000"), toxicity.train(docs, spark.createDataFrame(labels, LABELS))).toPandas()
    assert len(got) == 20 and (got.predicted == 1).all()


def test_pieces_give_one_good_model(spark):
    rows, labels = corpus(1800)
    docs = documents(spark, rows)
    got = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels, LABELS), piece_rows=100)).toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.doc_id.map({x[0]: x[2] for x in labels})).mean() > 0.95


def test_counts_of_tasks_add_up_to_those_of_all_rows(spark):
    rows, labels = corpus(300)
    data = [(r[1], x[2], r[2] if i % 5 else None) for i, (r, x) in enumerate(zip(rows, labels, strict=True))] + [(None, 0, "de")]
    counts = toxicity.Counts()
    for text, toxic, lang in data:
        counts.add(text and text.encode(), toxic, lang)
    found = toxicity._counted(spark.createDataFrame(data, "text string, toxic int, lang string").repartition(5), ["de", "en"])
    assert found.keys() == counts.of.keys() == {(0, None), (1, None), (2, "de"), (2, "en")}
    assert all((found[k] == counts.of[k]).all() for k in found)


def test_a_long_text_trains_as_in_one_piece(monkeypatch):
    rows, labels = corpus(120)
    model = toxicity.Model([r[1].encode() for r in rows], [x[2] for x in labels], [r[2] for r in rows], [r[0] for r in rows])
    vocabulary = toxicity.Vocabulary()
    ids = [[vocabulary[w] for w in toxicity.words_of(" ".join(r[1] for r in rows[a:b]).encode())] for a, b in ((0, 60), (60, 61), (61, 90))]
    hidden, spots = model.net.chosen(vocabulary.ids(), ids)
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 40)
    cut, places = model.net.chosen(vocabulary.ids(), ids)
    assert np.allclose(hidden, cut, atol=1e-5)
    alive = hidden.reshape(3, len(toxicity.WIDTHS), toxicity.FILTERS) > 0
    assert all((a == b)[alive[:, i]].all() for i, (a, b) in enumerate(zip(spots, places, strict=True)))


def test_thresholds_from_counted_logits():
    logit, y = np.array([3.0, 2.0, 1.0, -1.0, -2.0]), np.array([1.0, 1, 0, 1, 0])
    one = np.ones(5)
    exact = toxicity.Model._threshold(one, y, logit, logit)
    counted = toxicity.Model._threshold(np.array([2, 1, 1, 1.0]), np.array([2, 0, 1, 0.0]), np.array([2, 1, -1, -2.0]), np.array([3, 1, -1, -2.0]))
    assert exact == counted == -1.5
