import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql.classic.dataframe import DataFrame as Classic

from contestlab.llm import langid
from contestlab.llm.bytegram import Table, codes_of
from tests.llm.cases import HARD, documents


def brute_bits(train, text, order):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        b = b"\n" * order + t
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[k][b[i - k : i]][b[i]] += 1
    b, bits = b"\n" * order + text, 0.0
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            c = counts[k].get(b[i - k : i])
            if c:
                n, d = sum(c.values()), len(c)
                bits += np.log2((n + d) / (c[b[i]] or d))
                if c[b[i]]:
                    break
        else:
            bits += 8
    return bits


def test_code_lengths_equal_brute_force():
    train = {"a": [b"abra cadabra", b"abba", b""], "b": [b"xyz zyx abra", b"\xc3\xa9t\xc3\xa9"]}
    names, tree = langid.build({k: langid.count(v) for k, v in train.items()})
    for text in (b"abracadabra", b"qq", b"", b"xyz \xc3\xa9!", b"cadab" * 9):
        got = tree.score(codes_of([text], langid.ORDER)[0]).sum(axis=0) if text else np.zeros(2)
        assert np.allclose(got, [brute_bits(train[n], text, langid.ORDER) for n in names], atol=1e-3)


def test_table_finds_all_keys():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 5000).astype(np.uint64))
    table = Table(keys[::2])
    assert (table.find(keys[::2]) == np.arange(len(keys[::2]))).all() and (table.find(keys[1::2]) == -1).all()
    assert (Table(keys[:0]).find(keys) == -1).all()


def test_held_out_accuracy_pieces_and_und(spark, monkeypatch):
    rng = random.Random(4)
    parts = {"en": ["the", "thing", "with", "ing"], "fr": ["eau", "que", "étion", "le"], "de": ["sch", "ung", "über", "ein"]}
    rows = [(i, " ".join(rng.choice(parts[x]) + rng.choice(parts[x]) for _ in range(rng.randint(4, 30))), x, "s") for i in range(400) for x in [rng.choice(list(parts))]]
    docs = documents(spark, rows)
    model = langid.train(docs)
    got = langid.identify(docs, model).toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.doc_id.map({r[0]: r[2] for r in rows})).mean() > 0.97 and held.score.between(0, 1).all()
    texts = [r[1] for r in rows[:5]] + ["", None, "123 !?", "x" * 400]
    whole = langid.guess(texts, *model)
    monkeypatch.setattr(langid, "PIECE", 50)
    small = langid.guess(texts, *model)
    assert whole[0] == small[0] and np.allclose(whole[1], small[1], atol=1e-4) and whole[0][5:8] == ["und"] * 3


def test_blocks_of_a_long_text_are_counted_as_one_text(spark):
    text = "the thing with the ring " * 900
    docs = documents(spark, [(0, text, "en", "s"), (2, None, "en", "s")])
    whole = langid.build({"en": langid.count([text.encode()])})[1]
    cut = langid.train(docs, block=1000)[1]
    codes = codes_of([b"with the thing"], langid.ORDER)[0]
    assert np.allclose(whole.score(codes), cut.score(codes))
    small = langid.train(docs, sample_bytes=4000, block=100)[1]
    assert sum(map(len, small.values)) <= sum(map(len, cut.values))


def test_hard_rows(spark):
    docs = documents(spark, HARD)
    got = langid.identify(docs, langid.train(docs)).collect()
    assert len(got) == len(HARD) and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.identify(docs.limit(0), langid.train(docs.limit(0))).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_training_leaves_texts_where_they_are(spark, monkeypatch):
    """Whatever Spark's own threshold, no text is shuffled; labels beyond the most that are learnt are left out."""
    seen = []
    plain = Classic.mapInArrow
    monkeypatch.setattr(Classic, "mapInArrow", lambda self, *a, **b: (seen.append(self._jdf.queryExecution().executedPlan().toString()), plain(self, *a, **b))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = documents(spark, [(i, f"text of {x} " * 9, x, "s") for i in range(60) for x in ["en", "en", "fr", "de"][i % 4 : i % 4 + 1]])
        names, _ = langid.train(docs, languages=2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in seen[0] and "SortMergeJoin" not in seen[0] and len(names) == 2 and "en" in names
