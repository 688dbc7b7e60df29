"""The metric algebra: each metric as a Column function and as a SQL function of the same name.

Absent is NULL, never 0. Percentages are rounded half away from zero in integer arithmetic, so that they are
the same in any engine; a NULL or non-positive denominator gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CONFIDENT = 0.85
#: closeness, new voters, floating vote, volatility. Fixed values.
WEIGHTS = (0.35, 0.25, 0.20, 0.20)


def rounded(x: Column, k: int = 2) -> Column:
    """x to k places, half away from zero."""
    return F.signum(x) * F.floor(F.abs(x) * float(10**k) + 0.5).cast("double") / float(10**k)


def ratio(num: Column, den: Column, k: int, unit: int = 1) -> Column:
    """unit * num / den to k places, half away from zero, from integers."""
    h = F.floor((F.abs(num) * (2 * unit * 10**k) + den) / (den * 2)).cast("double") / float(10**k)
    return F.when(den > 0, F.signum(num) * h)


def pct(num: Column, den: Column, k: int = 2) -> Column:
    return ratio(num.cast("long"), den.cast("long"), k, 100)


def votes_polled(valid: Column, rejected: Column) -> Column:
    return valid + F.coalesce(rejected, F.lit(0))


def turnout_pct(polled: Column, electors: Column) -> Column:
    return pct(polled, electors)


def share_pct(votes: Column, valid: Column) -> Column:
    return pct(votes, valid)


def margin_votes(winner: Column, runner: Column, contestants: Column) -> Column:
    return F.when(contestants >= 2, winner - runner)


def margin_pct(winner: Column, runner: Column, contestants: Column, valid: Column) -> Column:
    return pct(margin_votes(winner, runner, contestants), valid)


def signed_margin_pct(winner_party: Column, winner: Column, runner: Column, contestants: Column, valid: Column, a: Column, b: Column) -> Column:
    margin = margin_pct(winner, runner, contestants, valid)
    return F.when(winner_party == a, margin).when(winner_party == b, -margin)


def comparison_allowed(confidence: Column, reviewed: Column, lineage: Column, aggregated: Column) -> Column:
    """Never NULL: a unit that was split or merged needs aggregated lineage, a weak link a review."""
    whole = F.coalesce(~lineage.isin("split", "merge"), F.lit(True)) | F.coalesce(aggregated, F.lit(False))
    linked = F.coalesce(reviewed, F.lit(False)) | F.coalesce(confidence >= CONFIDENT, F.lit(False))
    return whole & linked


def swing_pct(now: Column, before: Column, confidence: Column, reviewed: Column, lineage: Column, aggregated: Column) -> Column:
    return F.when(comparison_allowed(confidence, reviewed, lineage, aggregated), rounded(now - before))


def new_voter_pct(additions: Column, electors_end: Column) -> Column:
    return pct(additions, electors_end)


def net_roll_change_pct(additions: Column, deletions: Column, electors_start: Column) -> Column:
    return pct(additions - deletions, electors_start)


def transfer_delta(vs: Column, ls: Column) -> Column:
    return rounded(vs - ls)


def floating_pct(abs_sum: Column, poll_types: Column) -> Column:
    return F.when(poll_types == 2, rounded(abs_sum / 2))


def volatility(margins: Column) -> Column:
    """Sample deviation of an array's non-NULL values, NULL with fewer than two."""
    x = F.array_compact(margins)
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    mean = total / F.size(x)
    squares = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
    return F.when(F.size(x) >= 2, rounded(F.sqrt(squares / (F.size(x) - 1))))


def hundredths(x: Column) -> Column:
    """A two-place percentage as an exact long, for sums that don't depend on their order."""
    return (F.signum(x) * F.floor(F.abs(x) * 100.0 + 0.5)).cast("long")


def volatility_agg(margin: Column) -> Column:
    """The aggregate of the same meaning, for margins of two places, from exact sums."""
    h, n = hundredths(margin), F.count(margin)
    spread = (n * F.sum(h * h) - F.sum(h) * F.sum(h)).cast("double")
    return F.when(n >= 2, rounded(F.sqrt(F.try_divide(spread, (n * (n - 1)).cast("double"))) / 100.0))


def mean_agg(x: Column, k: int = 2) -> Column:
    """Mean of two-place values, to k places."""
    return ratio(F.sum(hundredths(x)), F.count(x) * 100, k)


def priority_weight(*inputs: Column) -> Column:
    weight = F.lit(0.0)
    for x, w in zip(inputs, WEIGHTS, strict=True):
        weight = weight + F.when(x.isNotNull(), w).otherwise(0.0)
    return rounded(weight, 4)


def priority_score(*inputs: Column) -> Column:
    """Weighted mean of the inputs that are there, with their weights renormalised."""
    total = F.lit(0.0)
    for x, w in zip(inputs, WEIGHTS, strict=True):
        total = total + F.coalesce(x * w, F.lit(0.0))
    return rounded(F.try_divide(total, priority_weight(*inputs)), 4)


def correlation(x: Column, y: Column, at_least: int = 2) -> Column:
    """Pearson's r, NULL for too few pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    spread = F.var_pop(px) * F.var_pop(py)
    return F.when(F.count(px) >= at_least, F.try_divide(F.covar_pop(px, py), F.sqrt(spread)))


def _r(x: str, k: int = 2) -> str:
    return f"(signum({x}) * CAST(floor(abs({x}) * {10**k}D + 0.5D) AS DOUBLE) / {10**k}D)"


def _p(num: str, den: str) -> str:
    return f"(CASE WHEN {den} > 0 THEN signum({num}) * CAST(floor((abs({num}) * 20000 + {den}) / ({den} * 2)) AS DOUBLE) / 100D END)"


_GATE = f"((coalesce(lineage NOT IN ('split', 'merge'), true) OR coalesce(aggregated, false)) AND (coalesce(reviewed, false) OR coalesce(confidence >= {CONFIDENT}D, false)))"
_WEIGHT = _r("(" + " + ".join(f"CASE WHEN {x} IS NOT NULL THEN {w}D ELSE 0D END" for x, w in zip("cnfv", WEIGHTS, strict=True)) + ")", 4)
_TOTAL = "(" + " + ".join(f"coalesce({x} * {w}D, 0D)" for x, w in zip("cnfv", WEIGHTS, strict=True)) + ")"
_MARGIN = _p("(CASE WHEN contestants >= 2 THEN winner - runner END)", "valid")
_COUNTED = "filter(margins, x -> x IS NOT NULL)"
_MEAN = f"(aggregate({_COUNTED}, 0D, (s, x) -> s + x) / size({_COUNTED}))"

#: name: (parameters, type, expression)
SQL_FUNCTIONS = {
    "metric_votes_polled": ("valid BIGINT, rejected BIGINT", "BIGINT", "valid + coalesce(rejected, 0)"),
    "metric_turnout_pct": ("polled BIGINT, electors BIGINT", "DOUBLE", _p("polled", "electors")),
    "metric_share_pct": ("votes BIGINT, valid BIGINT", "DOUBLE", _p("votes", "valid")),
    "metric_margin_votes": ("winner BIGINT, runner BIGINT, contestants BIGINT", "BIGINT", "CASE WHEN contestants >= 2 THEN winner - runner END"),
    "metric_margin_pct": ("winner BIGINT, runner BIGINT, contestants BIGINT, valid BIGINT", "DOUBLE", _MARGIN),
    "metric_signed_margin_pct": ("winner_party STRING, winner BIGINT, runner BIGINT, contestants BIGINT, valid BIGINT, a STRING, b STRING", "DOUBLE", f"CASE WHEN winner_party = a THEN {_MARGIN} WHEN winner_party = b THEN -{_MARGIN} END"),
    "metric_comparison_allowed": ("confidence DOUBLE, reviewed BOOLEAN, lineage STRING, aggregated BOOLEAN", "BOOLEAN", _GATE),
    "metric_swing_pct": ("now DOUBLE, before DOUBLE, confidence DOUBLE, reviewed BOOLEAN, lineage STRING, aggregated BOOLEAN", "DOUBLE", f"CASE WHEN {_GATE} THEN {_r('(now - before)')} END"),
    "metric_new_voter_pct": ("additions BIGINT, electors_end BIGINT", "DOUBLE", _p("additions", "electors_end")),
    "metric_net_roll_change_pct": ("additions BIGINT, deletions BIGINT, electors_start BIGINT", "DOUBLE", _p("(additions - deletions)", "electors_start")),
    "metric_transfer_delta": ("vs DOUBLE, ls DOUBLE", "DOUBLE", _r("(vs - ls)")),
    "metric_floating_pct": ("abs_sum DOUBLE, poll_types BIGINT", "DOUBLE", f"CASE WHEN poll_types = 2 THEN {_r('(abs_sum / 2)')} END"),
    "metric_volatility": ("margins ARRAY<DOUBLE>", "DOUBLE", f"CASE WHEN size({_COUNTED}) >= 2 THEN {_r(f'sqrt(aggregate({_COUNTED}, 0D, (s, x) -> s + (x - {_MEAN}) * (x - {_MEAN})) / (size({_COUNTED}) - 1))')} END"),
    "metric_priority_weight": ("c DOUBLE, n DOUBLE, f DOUBLE, v DOUBLE", "DOUBLE", _WEIGHT),
    "metric_priority_score": ("c DOUBLE, n DOUBLE, f DOUBLE, v DOUBLE", "DOUBLE", _r(f"try_divide({_TOTAL}, {_WEIGHT})", 4)),
}


def register(spark: SparkSession) -> None:
    """Install the metrics as SQL functions; Catalyst inlines them."""
    for name, (parameters, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
