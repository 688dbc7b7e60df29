"""Order-dependent near-duplicate removal of titles by 64-bit SimHash, and exact vector search.

A title goes if an earlier one that stays lies within HAMMING bits. Two hashes that differ in 3 bits agree
in three of six segments, so each hash is joined under the 20 choices of three segments (32 bits or so each);
the pairs found are tested in full. Copies of one hash follow their first. The sequential rule is then worked
out over the links alone, in rounds while they are many: what has no earlier neighbour left stays, and what has one that stays goes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.functions import text as T
from contestlab.shared import shared_dir, written

#: Links that one task may hold.
FEW = 100_000
SEGMENTS = ((53, 11), (42, 11), (31, 11), (20, 11), (10, 10), (0, 10))


def sorted_join(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join through shuffles, for tables that grow with the titles: their files look so small that Spark would send them whole through the driver."""
    return a.join(b.hint("merge"), on, how)


def segment_keys(simhash: Column) -> list[Column]:
    """The 20 keys of a hash: each choice of three of its six segments. Hashes within 3 bits share one at least."""
    part = lambda i: F.shiftrightunsigned(simhash, SEGMENTS[i][0]).bitwiseAND(F.lit((1 << SEGMENTS[i][1]) - 1))
    return [F.concat(F.lit(chr(65 + n)), *(F.lpad(F.hex(part(i)), 3, "0") for i in three)) for n, three in enumerate(combinations(range(len(SEGMENTS)), 3))]


def links(hashes: DataFrame, threshold: int = T.HAMMING) -> DataFrame:
    """u, v: the pairs of distinct hashes (id, simhash) within threshold bits, u before v by id."""
    if not 0 <= threshold <= 3:
        raise ValueError("the segments serve up to 3 differing bits")
    rows = hashes.select("id", "simhash", F.explode(F.array(*segment_keys(F.col("simhash")))).alias("key"))
    a, b = rows.alias("a"), rows.alias("b")
    near = (F.col("a.id") < F.col("b.id")) & (T.hamming(F.col("a.simhash"), F.col("b.simhash")) <= threshold)
    return sorted_join(a, b, (F.col("a.key") == F.col("b.key")) & near).select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rule one title after another, over all links at once."""
    gone: set[int] = set()
    for later, earlier in sorted((int(v), int(u)) for frame in frames for u, v in zip(frame["u"], frame["v"], strict=True)):
        if earlier not in gone:  # its own fate is known by now
            gone.add(later)
    yield pd.DataFrame({"id": sorted(gone)}, dtype="int64")


def settle(edges: DataFrame, few: int = FEW) -> DataFrame:
    """id of what goes. edges (u, v; stored): pairs that are near, u before v; v goes if a u of its that stays is near.

    Rounds take what is settled at both ends of the links; once no more than `few` links are left, such as a long chain, which would
    take a round for every second title, one task goes through them in order.
    """
    gone, left = edges.select(F.col("u").alias("id")).limit(0), edges
    while n := left.count():
        if n <= few:
            return gone.unionByName(written(left.coalesce(1).mapInPandas(_in_order, "id long"), "gone"))
        later = left.select(F.col("v").alias("id")).distinct()
        stay = sorted_join(left.select(F.col("u").alias("id")).distinct(), later, "id", "left_anti")
        out = written(sorted_join(left, stay.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("id")).distinct(), "gone")
        gone = gone.unionByName(out)
        # what goes takes its links along; so do those that stay, as all their neighbours are gone
        for end in "uv":
            left = sorted_join(left, out.select(F.col("id").alias(end)), end, "left_anti").select("u", "v")
        left = written(left, "left")
    return gone


def first_seen(items: DataFrame, threshold: int = T.HAMMING) -> DataFrame:
    """items (id, simhash; earlier ids come first) with kept, and of the first of its hash, `of`."""
    # a minimum that is aggregated before the shuffle: copies of one hash don't meet in one task
    rows = sorted_join(items.select("id", "simhash"), items.groupBy("simhash").agg(F.min("id").alias("of")), "simhash")
    edges = written(links(rows.filter("id = of").select("id", "simhash"), threshold), "near")
    marked = settle(edges).withColumnRenamed("id", "of").distinct().withColumn("gone", F.lit(True))
    return sorted_join(rows, marked, "of", "left").select("id", "simhash", (F.col("gone").isNull() & (F.col("id") == F.col("of"))).alias("kept"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def by_length(column: pa.Array):
    """(rows, matrix) for the rows of each length."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        some = column if len(rows) == len(column) else column.take(pa.array(rows))
        yield rows, np.asarray(some.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), -1)


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last as dot() does, so that equal vectors score alike to the last bit."""
    return np.add.accumulate(a * b, axis=-1)[..., -1]


def _closest(ids: np.ndarray, asked: np.ndarray, norms: np.ndarray, k: int):
    """Batches of (vec_id, embedding, norm): the rows that are among the k closest of a batch's and all earlier ones, for each query.

    All similarities come from one product of matrices; those that may be among the k closest are then summed in order.
    """

    def run(batches):
        best = np.full((len(ids), k), -np.inf)  # the k largest so far, the least first
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                piece = batch.slice(a, ROWS)
                for rows, x in by_length(piece.column("embedding")):
                    if x.shape[1] != asked.shape[1]:
                        continue
                    vec, norm = piece.column("vec_id").to_numpy(zero_copy_only=False)[rows], piece.column("norm").to_numpy(zero_copy_only=False)[rows]
                    with np.errstate(all="ignore"):
                        near = (asked @ x.T) / np.outer(norms, norm)
                    near[np.isnan(near)] = np.inf  # largest, as in Spark
                    every = np.concatenate([best, near], axis=1)
                    best = np.partition(every, every.shape[1] - k, axis=1)[:, -k:]
                    least = best.min(axis=1, keepdims=True)
                    q, v = np.nonzero(near >= np.where(np.isfinite(least), least - SLACK, least))
                    for i in range(0, len(q), SUMMED):
                        qs, vs = q[i : i + SUMMED], v[i : i + SUMMED]
                        with np.errstate(all="ignore"):
                            exact = _sums(x[vs], asked[qs]) / (norm[vs] * norms[qs])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[qs]), pa.array(vec[vs]), pa.array(exact)], ["query_id", "vec_id", "similarity"])

    return run


#: Vectors of a product of matrices, pairs that are summed at a time, and by how much a product may be off.
ROWS, SUMMED, SLACK = 1024, 65_536, 1e-9


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10, max_queries: int = 2000) -> DataFrame:
    """query_id, vec_id, similarity, place: the k vectors (vec_id, embedding) of largest cosine for each query (query_id, embedding), exactly.

    Every vector is compared with every query of its length, in blocks of about max_queries queries by a hash of their id: a block
    is sent to all tasks, which multiply it with their vectors and pass on the k best that they have met. Of several blocks each is
    written to the shared folder, so neither the number of queries nor the plan has a limit. Pairs grow with the product of both tables; a task holds a block and ROWS vectors.
    """
    double = F.col("embedding").cast("array<double>").alias("embedding")
    unit = lambda df, key: df.filter(dot(F.col("embedding"), F.col("embedding")) > 0).select(F.col(key).cast("long").alias(key), double, F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("norm"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    schema = "query_id long, vec_id long, similarity double"
    rows = unit(vectors, "vec_id")

    def best(block: DataFrame) -> DataFrame:
        asked, found = unit(block, "query_id").toArrow().combine_chunks(), None
        lists = asked["embedding"].combine_chunks()
        for at, q in by_length(lists):
            ids, norms = asked["query_id"].to_numpy()[at], asked["norm"].to_numpy()[at]
            near = rows.mapInArrow(_closest(ids, q, norms, k), schema)
            found = near if found is None else found.unionByName(near)
        if found is None:
            found = vectors.sparkSession.createDataFrame([], schema)
        return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)

    blocks = -(-queries.count() // max_queries)
    if blocks <= 1:
        return best(queries)
    path, block = f"{shared_dir(vectors.sparkSession)}/found-{uuid.uuid4().hex}", F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    for i in range(blocks):
        found = best(queries.filter(block == i))
        found.write.mode("append").parquet(path)
    return vectors.sparkSession.read.schema(found.schema).parquet(path)
