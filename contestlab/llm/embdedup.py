"""Near-duplicate embeddings by sign hashing with exact verification.

Rows with equal label and equal vector are one class. Each class is hashed into several tables; in each, the signs
against random hyperplanes are the bucket. The planes grow with the logarithm of the largest label's classes, so that
vectors that aren't near seldom share a bucket at any size. Two vectors with cosine 0.98 fall on the same side of
a plane with probability 1 - acos(0.98) / pi = 0.936; there are as many tables as make the probability that all
planes of one of them agree at least 1 - MISS: 25 tables of 15 planes for 5,000 classes, 36 of 20 for 200,000. Inside a
bucket cosines are computed in double precision, and a pair counts in the first table in which it meets, so link
counts are exact for what is found.

Buckets are found and counted by keys alone; a vector is sent only to those of its buckets that hold another one,
once each. A bucket of more than BLOCK vectors is cut into blocks, each pair of blocks is one group of bounded
size, and a vector is sent once for each block: such a bucket is mostly true near vectors, whose links have to be counted, and
that work grows with their pairs. Vectors that share a bucket of the first table aren't compared again in later
ones where they fill whole chunks. A task reads its groups as a stream, sorted by group, and gives counts of links
and, for its own links, a star for each of their components: never the pairs. The stars meet in distributed connected components.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, or whose label or id
is null, links with nothing: 0 links, itself its component (null for a null id), kept. Vectors of different
length don't link. Repeated rows link with each other. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .graph import connected_components
from .vectors import by_length, usable

COSINE, MISS, BLOCK, SMALL, SEED = 0.98, 1e-5, 1024, 32, 11


def tables_for(planes: int, cosine: float = COSINE, miss: float = MISS) -> int:
    """Tables that leave a pair of that cosine apart with probability miss at most."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-((1 - math.acos(min(1.0, cosine)) / math.pi) ** planes) + 1e-300)))


def _hash(planes: int, tables: int):
    def run(batches):
        for batch in batches:
            keys = np.zeros((batch.num_rows, tables), np.int32)
            for rows, x in by_length(batch.column("embedding")):
                normals = np.random.default_rng([SEED, x.shape[1]]).normal(size=(x.shape[1], tables * planes))
                for i in range(0, len(rows), 1024):
                    keys[rows[i : i + 1024]] = (x[i : i + 1024] @ normals > 0).reshape(-1, tables, planes) @ (1 << np.arange(planes, dtype=np.int32))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "keys"])

    return run


def _pairs(unit: np.ndarray, start: np.ndarray, size: np.ndarray, first_key: np.ndarray, table_no: np.ndarray, cosine: float):
    """(i, j): rows of one group at a cosine of at least `cosine`, i < j. start, size: of each row's group; a group's rows lie side by side, sorted by first_key."""
    n = len(unit)
    end, small = start + size, size <= SMALL
    for d in range(1, int(size[small].max(initial=0))):
        i = np.flatnonzero(small & (np.arange(n) + d < end))
        i = i[np.einsum("ij,ij->i", unit[i], unit[i + d]) >= cosine]
        yield i, i + d
    for s, e in {(s, e) for s, e in zip(start[~small].tolist(), end[~small].tolist(), strict=True)}:
        for a in range(s, e, 256):
            b, lo = min(a + 256, e), a
            if table_no[a] and first_key[a] == first_key[b - 1]:  # met in the first table
                lo = a + int(np.searchsorted(first_key[a:e], first_key[a], "right"))
            i, j = np.nonzero(unit[a:b] @ unit[lo:e].T >= cosine)
            i, j = i + a, j + lo
            later = j > i
            yield i[later], j[later]


def _links(cosine: float):
    """Groups, sorted: cid, links, root (the least cid of its star)."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        group = np.stack([rows[c].to_numpy() for c in ("bucket", "b1", "b2")], axis=1)
        new = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(new, len(group)))
        size = np.repeat(sizes, sizes)
        cid, block, copies, t = (rows[c].to_numpy() for c in ("cid", "block", "copies", "t"))
        keys = rows["keys"].combine_chunks().flatten().to_numpy().reshape(len(cid), -1)
        two, links, edges = group[:, 1] != group[:, 2], np.zeros(len(cid), np.int64), []
        for own, x in by_length(rows["embedding"].combine_chunks()):  # the rows of a group have one length
            unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
            start = np.searchsorted(own, np.repeat(new, sizes)[own])
            for i, j in _pairs(unit, start, size[own], keys[own, 0], t[own], cosine):
                i, j = own[i], own[j]
                far = ~two[i] | (block[i] != block[j])
                i, j = i[far], j[far]
                edges.append((i, j))
                for k in range(0, len(i), 1 << 16):
                    u, v = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    first = (keys[u] == keys[v]).argmax(axis=1) == t[u]
                    np.add.at(links, u[first], copies[v[first]])
                    np.add.at(links, v[first], copies[u[first]])
        comp = np.arange(len(cid))
        i, j = (np.concatenate(e) for e in zip(*edges, strict=True)) if edges else (comp[:0], comp[:0])
        while True:  # components: the least row spreads along links, by jumps
            low, before = np.minimum(comp[i], comp[j]), comp
            comp = comp.copy()
            for end in (before[i], before[j], i, j):
                np.minimum.at(comp, end, low)
            comp = comp[comp]
            if (comp == before).all():
                break
        told = (links > 0) | (comp != np.arange(len(comp)))
        return pa.RecordBatch.from_arrays([pa.array(cid[told]), pa.array(links[told]), pa.array(cid[comp][told])], ["cid", "links", "root"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            last = [held[c][-1] for c in ("bucket", "b1", "b2")]
            # the last group may go on in the next batch
            same = np.all([held[c].to_numpy() == x.as_py() for c, x in zip(("bucket", "b1", "b2"), last, strict=True)], axis=0)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield found(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield found(held)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, planes: int | None = None, tables: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label). planes, tables: by default from the classes of the largest label."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    live = usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    # + 0.0 turns -0.0 into 0.0: equal vectors have equal arrays
    good = rows.filter(live).withColumn("embedding", F.transform("embedding", lambda v: v + 0.0))
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    planes = planes or min(30, max(8, most.bit_length() + 2))
    tables = tables or tables_for(planes, cosine)
    hashed = classes.select("cid", "copies", "embedding").mapInArrow(_hash(planes, tables), "cid long, copies long, embedding array<double>, keys array<int>")
    hashed = materialize(hashed, "hashed")
    labels = classes.select("cid", F.concat_ws(":", F.size("embedding"), "label").alias("label"))
    spots = hashed.select("cid", F.posexplode("keys").alias("t", "key")).join(labels, "cid")
    bucket = ["label", "t", "key"]
    buckets = spots.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = materialize(buckets.select(F.monotonically_increasing_id().alias("bucket"), *bucket, F.ceil(F.col("size") / block).cast("int").alias("blocks")), "buckets")
    met = spots.join(buckets, bucket).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = met.select("bucket", "t", "cid", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("bucket", "t", "cid", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2")).join(hashed, "cid")
    group = ["bucket", "b1", "b2"]
    met = met.repartition(*group).sortWithinPartitions(*group, F.col("keys")[0], "cid")
    found = materialize(met.mapInArrow(_links(cosine), "cid long, links long, root long"), "links")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    joined = classes.select("cid", "first_id", "copies").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    joined = joined.join(least, "component").join(counts, "cid", "left")
    marked = classes.select("cid", "label", "embedding").join(joined.select("cid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "cid").drop("cid")
    linked = good.join(marked, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~live).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_hyperplane_dedup": op5}
SQL = {
    "op5_hyperplane_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS m FROM reach GROUP BY 1), n AS (SELECT u, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(least(vec_id, coalesce(m, vec_id)) AS BIGINT) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.u LEFT JOIN n ON vec_id = n.u"""
}
