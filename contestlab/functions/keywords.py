"""Many keywords looked for at once: one automaton of all of them, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import text as T

# Fixed values.
WARDS, SHORTEST = ("ward", "वार्ड"), 5


@lru_cache(8)
def automaton(keywords: tuple[str, ...]):
    """Once for each Python worker and set of keywords."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, k in enumerate(keywords):
        found.add_word(k, i)
    found.make_automaton()
    return found


def places(text: str, keywords: tuple[str, ...]) -> list[int]:
    """Which keywords the text holds, by their numbers, in order."""
    return sorted({i for _, i in automaton(keywords).iter(text)})


def named_in(folded: Column, keywords: Iterable[str]) -> Column:
    """The keywords that a folded text holds anywhere, in their order; none for a null text. The time doesn't depend on how many there are."""
    wanted = tuple(dict.fromkeys(k for k in keywords if k))
    if not wanted:
        return F.array().cast("array<string>")

    @F.arrow_udf(ArrayType(StringType()))
    def found(texts: pa.Array) -> pa.Array:
        return T.by_few(texts, lambda t: [wanted[i] for i in places(t, wanted)] if t else [], pa.list_(pa.string()))

    return found(folded)


def area_keywords(areas: DataFrame, fixed: Sequence[str] = (), name: str = "name", most: int = 100_000) -> list[str]:
    """Keywords for named_in(): fixed ones and the folded names of areas of SHORTEST characters or more, but for numbered wards. Areas are a reference table; more than `most` names are refused."""
    rows = areas.select(T.fold(F.col(name)).alias("k")).filter(F.length("k") >= SHORTEST)
    for w in WARDS:
        rows = rows.filter(~F.startswith("k", F.lit(w)))
    found = {r.k for r in rows.distinct().limit(most + 1).collect()}
    if len(found) > most:
        raise ValueError(f"more than {most} names of areas")
    own = areas.sparkSession.createDataFrame([(k,) for k in fixed], "k string").select(T.fold(F.col("k")).alias("k"))
    return sorted(found | {r.k for r in own.collect() if r.k})
