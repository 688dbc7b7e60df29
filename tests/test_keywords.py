"""Many keywords at once: the same as looking for each, and no slower for more of them."""

import random
import time

import pytest

from contestlab.functions import keywords as K


def test_found_as_by_looking_for_each(spark):
    rng = random.Random(1)
    wanted = ["abc", "bc", "c d", "विद्यालय", "", "zz", "abc"] + ["".join(rng.choice("abcd ") for _ in range(4)) for _ in range(60)]
    texts = [None, "", "abc d", "यह विद्यालय है"] + ["".join(rng.choice("abcd ") for _ in range(80)) for _ in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.k for r in df.select("i", K.named_in(df.t, wanted).alias("k")).collect()}
    distinct = list(dict.fromkeys(k for k in wanted if k))
    assert got == {i: [k for k in distinct if t and k in t] for i, t in enumerate(texts)}
    assert df.select(K.named_in(df.t, []).alias("k")).first().k == []


def test_time_is_flat_in_the_number_of_keywords():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    texts, took = [" ".join(word() for _ in range(300)) for _ in range(60)], []
    for n in (50, 5000):
        keys = tuple(word() for _ in range(n))
        K.automaton(keys)
        t = time.perf_counter()
        for text in texts:
            K.places(text, keys)
        took.append(time.perf_counter() - t)
    assert took[1] < 6 * took[0] + 0.2


def test_area_keywords(spark):
    areas = spark.createDataFrame([("North  Side",), ("Ward 7 east",), ("वार्ड 3 गांव",), ("Old",), (None,), ("NORTH side",)], "name string")
    assert K.area_keywords(areas, ["AC-32", "x"]) == sorted(["north side", folded(spark, "AC-32"), "x"])
    with pytest.raises(ValueError):
        K.area_keywords(spark.createDataFrame([(f"place {i}",) for i in range(9)], "name string"), most=5)


def folded(spark, text):
    from pyspark.sql import functions as F

    from contestlab.functions import text as T

    return spark.createDataFrame([(text,)], "t string").select(T.fold(F.col("t"))).first()[0]


def test_long_texts_are_taken_few_at_a_time():
    import pyarrow as pa

    from contestlab.functions import text as T

    held = []
    texts = pa.array(["é" * 300 + str(i) if i % 7 else None for i in range(100)])
    got = T.by_few(texts, lambda t: held.append(t) or (t and len(t)), pa.int64(), octets=2000)
    assert got.to_pylist() == [None if t is None else len(t) for t in texts.to_pylist()] and held == texts.to_pylist()
    assert T.by_few(texts.slice(0, 0), len, pa.int64()).to_pylist() == []
    # composed() and simhash() get Arrow's arrays, not a Series of all texts
    assert all("ARROW" in str(f.evalType) or f.evalType == 250 for f in (T.composed, T.simhash))


def test_keywords_get_arrows_arrays(spark):
    from pyspark.sql import functions as F

    plan = spark.createDataFrame([("a",)], "t string").select(K.named_in(F.col("t"), ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "], 250" in plan  # SQL_SCALAR_ARROW_UDF
