"""Each metric by hand, as a Column and as a SQL function."""

import pytest
from pyspark.sql import functions as F

from contestlab.functions import metrics as M

CASES = [
    ("votes_polled", (1000, 12), 1012),
    ("votes_polled", (1000, None), 1000),
    ("votes_polled", (None, 5), None),
    ("turnout_pct", (1012, 1500), 67.47),
    ("turnout_pct", (1012, 0), None),
    ("turnout_pct", (1012, None), None),
    ("share_pct", (81300, 190550), 42.67),
    ("share_pct", (0, 100), 0.0),
    ("share_pct", (None, 100), None),
    ("margin_votes", (81300, 77145, 2), 4155),
    ("margin_votes", (81300, None, 1), None),
    ("margin_pct", (81300, 77145, 3, 190550), 2.18),
    ("new_voter_pct", (12, 900), 1.33),
    ("new_voter_pct", (None, 900), None),
    ("new_voter_pct", (12, 0), None),
    ("net_roll_change_pct", (5, 20, 1000), -1.5),
    ("transfer_delta", (40.0, 50.5), -10.5),
    ("transfer_delta", (40.0, None), None),
    ("floating_pct", (14.0, 2), 7.0),
    ("floating_pct", (100.0, 1), None),
    ("volatility", ([1.85, -3.2, 5.6],), 4.42),
    ("volatility", ([10.0, 20.0],), 7.07),
    ("volatility", ([10.0, None],), None),
    ("volatility", ([10.0, -30.0, 0.0],), 20.82),
    ("priority_score", (0.8, 0.6, 0.5, 0.4), 0.61),
    ("priority_score", (0.8, 0.6, None, 0.4), 0.6375),
    ("priority_score", (None, None, None, None), None),
    ("priority_weight", (0.8, 0.6, None, 0.4), 0.8),
    ("comparison_allowed", (0.85, False, None, False), True),
    ("comparison_allowed", (0.84, False, None, False), False),
    ("comparison_allowed", (0.5, True, "split", False), False),
    ("comparison_allowed", (0.5, True, "merge", True), True),
    ("comparison_allowed", (None, None, None, None), False),
    ("swing_pct", (30.0, 43.0, 0.9, False, None, False), -13.0),
    ("swing_pct", (30.0, None, 0.9, False, None, False), None),
    ("swing_pct", (30.0, 43.0, 0.6, False, None, False), None),
    ("signed_margin_pct", ("A", 500, 400, 3, 1000, "A", "B"), 10.0),
    ("signed_margin_pct", ("B", 600, 300, 3, 1000, "A", "B"), -30.0),
    ("signed_margin_pct", ("C", 600, 300, 3, 1000, "A", "B"), None),
]


@pytest.fixture(scope="module")
def results(spark):
    M.register(spark)
    columns = []
    for i, (name, args, _) in enumerate(CASES):
        kinds = [p.split()[1].lower() for p in M.SQL_FUNCTIONS[f"metric_{name}"][0].split(", ")]
        values = [F.lit(a).cast(k) if not isinstance(a, list) else F.array(*map(F.lit, a)).cast(k) for a, k in zip(args, kinds, strict=True)]
        columns += [getattr(M, name)(*values).alias(f"c{i}"), F.call_function(f"metric_{name}", *values).alias(f"s{i}")]
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_metric(results, i):
    want = CASES[i][2]
    assert results[f"c{i}"] == want and results[f"s{i}"] == want, CASES[i]


def test_zero_variance_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 3.0, 5.0), (None, 1.0, 1.0)], "a double, b double, c double")
    r = df.agg(M.correlation(F.col("a"), F.col("b")).alias("ab"), M.correlation(F.col("b"), F.col("c")).alias("bc"), M.correlation(F.col("b"), F.col("c"), 4).alias("few"), M.volatility_agg(F.col("b")).alias("v"), M.mean_agg(F.col("c")).alias("m")).first()
    assert r.ab is None and round(r.bc, 6) == 1.0 and r.few is None and r.v == 1.0 and r.m == 3.0
