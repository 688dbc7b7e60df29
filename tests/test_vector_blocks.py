from contestlab.operators import dedupe


def test_more_queries_than_a_block(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 11), float(i % 5) - 2]) for i in range(1, 60)], "vec_id long, embedding array<double>")
    queries = df.withColumnRenamed("vec_id", "query_id")
    want = sorted(map(tuple, dedupe.vector_search(df, queries, k=3).collect()))
    got = dedupe.vector_search(df, queries, k=3, max_queries=8)
    assert got.columns == ["query_id", "vec_id", "similarity", "place"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_closest_by_matrices(spark):
    """No join of all pairs, ties by id, odd vectors as before."""
    rows = [(i, [float(i % 3), 1.0, 0.5]) for i in range(40)] + [(50, None), (51, [0.0] * 3), (52, [1.0, None, 1.0]), (53, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = dedupe.vector_search(df, df.withColumnRenamed("vec_id", "query_id"), k=15)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.place):
        got.setdefault(r.query_id, []).append(r.vec_id)
    own = lambda i: [j for j in range(40) if j % 3 == i % 3]
    assert set(got) == {*range(40), 53} and got[53] == [53]
    assert all(v[: len(own(q))] == own(q) and len(v) == 15 for q, v in got.items() if q < 40)
