"""Approximate nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids (the square root of the rows, MAX_LISTS at most) cut the vectors into lists; the residual
to its centroid is coded in PARTS parts of one byte. Both codebooks are fitted in numpy on a bounded sample, SAMPLE
rows for each list's centroid and SAMPLE * LEAST_SAMPLE at least, drawn by a hash of the id; every row is indexed.

What is found is exact on any rows, because all that is left out is left out by a bound. The sample's own k-th best is
no more than the true one, and no vector of a list lies further from its centroid than the list's radius: a query probes the lists
whose bound reaches it. In these it sums a table of the inner products of its parts with all codewords
(asymmetric tables) over the codes. The best k by that sum are ranked on the original vectors, and so are all whose sum and coding error
together reach the worst of those, in double precision.

Lists are dealt into shards of about SHARD rows, a list larger than that into several; a shard's rows are sent once,
sorted by list, and followed by the queries that probe a list of it. A task holds one shard at a time and reads the queries as
a stream, so its memory is bounded however many there are. Beyond MAX_LISTS squared rows lists grow longer.

The test vectors have almost no cluster structure, so that nearly all lists must be probed; on clustered data few are.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components or that have a null id
take no part; vectors of different length aren't compared: each length has an index of its own. Equal inner products
go to the smaller id. Rows with one id count as one candidate, the best of them. With fewer candidates than k all are
returned. Without queries or candidates the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import matrix, usable

K, EVERY, PARTS = 20, 20, 32
SAMPLE, LEAST_SAMPLE, MAX_LISTS, SHARD, ROUNDS, SEED = 16, 1024, 4096, 32_768, 8, 5
#: Bytes of the vectors of a shard, and what single precision may lose of a sum.
SHARD_BYTES, LOST = 32 << 20, 1e-5


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _units(q: np.ndarray) -> np.ndarray:
    """Queries of length 1: what is nearest doesn't depend on their length."""
    q = q / np.abs(q).max(axis=1, keepdims=True)
    return q / np.linalg.norm(q, axis=1, keepdims=True)


class Index:
    """The codebooks, of vectors divided by scale, and the sample that they were fitted on."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, lists: int, scale: float, parts: int = PARTS):
        self.scale, self.ids, self.sample = scale, ids, (sample / scale).astype(np.float32)
        rng, x = np.random.default_rng(SEED), self.sample
        self.centres = _kmeans(x, max(1, min(lists, len(x))), rng)
        parts = max(p for p in range(1, min(parts, x.shape[1]) + 1) if x.shape[1] % p == 0)
        rest = (x - self.centres[_nearest(x, self.centres)]).reshape(len(x), parts, -1)
        self.words = np.stack([_kmeans(rest[:, p], min(256, len(x)), rng) for p in range(parts)])
        self.radius = np.zeros(len(self.centres))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's list, codes, distance from the centroid, and what its codes may be off by in an inner product with a query of length 1."""
        x = x / self.scale
        cell = _nearest(x.astype(np.float32), self.centres)
        rest = (x - self.centres[cell]).reshape(len(x), len(self.words), -1)
        codes = np.stack([_nearest(rest[:, p].astype(np.float32), w) for p, w in enumerate(self.words)], axis=1).astype(np.uint8)
        coded = np.stack([w[codes[:, p]] for p, w in enumerate(self.words)], axis=1)
        lost = LOST * (np.linalg.norm(self.centres[cell], axis=1) + np.linalg.norm(coded.reshape(len(x), -1), axis=1))
        away = np.linalg.norm(rest.reshape(len(x), -1), axis=1)
        return cell, codes, away + lost, np.linalg.norm((rest - coded).reshape(len(x), -1), axis=1) + lost

    def reached(self, qid: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """The k-th best inner product of each query (of length 1) in the sample, or minus infinity: the true one is no less."""
        if len(self.ids) <= k:
            return np.full(len(q), -np.inf)
        near = q.astype(np.float32) @ self.sample.T
        near[qid[:, None] == self.ids] = -np.inf
        least = np.partition(near, len(self.ids) - k, axis=1)[:, len(self.ids) - k]
        return least.astype(np.float64) - LOST * np.linalg.norm(self.sample, axis=1).max()

    def probes(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which lists each query probes: those that may hold a vector of at least so large an inner product."""
        lost = LOST * np.linalg.norm(self.centres, axis=1)
        return q.astype(np.float32) @ self.centres.T + (self.radius + lost)[None] >= least[:, None]


class Shard:
    """Rows of a shard, sorted by list."""

    def __init__(self, index: Index, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        self.index, self.ids, cell = index, rows["vec_id"].to_numpy(), rows["cell"].to_numpy()
        self.codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.off, self.x = rows["off"].to_numpy(), matrix(rows["x"].combine_chunks())
        self.cells, first = np.unique(cell, return_index=True)
        self.ends = np.append(first, len(cell))

    def _sums(self, q: np.ndarray, probes: np.ndarray) -> np.ndarray:
        """Inner products by the codes, in the probed lists."""
        q = q.astype(np.float32)
        tables = np.einsum("qpd,pwd->qpw", q.reshape(len(q), len(self.index.words), -1), self.index.words)
        score = np.full((len(q), len(self.ids)), -np.inf, np.float32)
        for i, c in enumerate(self.cells.tolist()):
            who = np.flatnonzero(probes[:, c])
            if len(who):
                a, b = self.ends[i], self.ends[i + 1]
                found = np.repeat((q[who] @ self.index.centres[c])[:, None], b - a, axis=1)
                for p in range(tables.shape[1]):
                    found += tables[who, p][:, self.codes[a:b, p]]
                score[who, a:b] = found
        return score

    def near(self, qid: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> pa.RecordBatch:
        """query_id, vec_id, score: the k best rows of the shard for each query."""
        unit = _units(q)
        score = self._sums(unit, self.index.probes(unit, least))
        score[qid[:, None] == self.ids] = -np.inf
        who, ids, scores = [], [], []
        for i, sums in enumerate(score):
            t = least[i]
            if len(sums) > k:
                first = np.argpartition(-sums, k - 1)[:k]
                if np.isfinite(sums[first]).all() and len(np.unique(self.ids[first])) == k:
                    t = max(t, ((self.x[first] / self.index.scale) @ unit[i]).min() - 1e-9)
            found = np.flatnonzero((sums + self.off >= t) & (sums > -np.inf))
            with np.errstate(all="ignore"):
                exact = np.add.accumulate(self.x[found] * q[i], axis=1)[:, -1]  # summed in order: equal vectors score alike
            order = np.lexsort((self.ids[found], -np.where(np.isnan(exact), np.inf, exact)))
            _, one = np.unique(self.ids[found][order], return_index=True)  # of rows with one id the best
            order = order[np.sort(one)[:k]]
            who.append(np.full(len(order), i))
            ids.append(self.ids[found[order]])
            scores.append(exact[order])
        return pa.RecordBatch.from_arrays([pa.array(qid[np.concatenate(who)]), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], ["query_id", "vec_id", "score"])


def _scan(index: Index, k: int):
    """Rows sorted by shard: those of the shard first, sorted by list, then its queries."""

    def run(batches):
        at, parts, shard = None, [], None
        for batch in batches:
            number, query = batch.column("shard").to_numpy(), batch.column("codes").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (query[1:] != query[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if number[a] != at:
                    at, parts, shard = number[a], [], None
                some = batch.slice(a, b - a)
                if not query[a]:
                    parts.append(some)
                elif parts:
                    shard = shard or Shard(index, parts)
                    for i in range(0, some.num_rows, 64):
                        asked = some.slice(i, 64)
                        yield shard.near(asked.column("vec_id").to_numpy(), matrix(asked.column("x")), asked.column("off").to_numpy(), k)

    return run


def _search(rows: DataFrame, asked: DataFrame, n: int, k: int, dim: int, scale: float) -> DataFrame:
    """search() for usable vectors of one length, none of whose components is larger than scale; n: how many rows."""
    spark = rows.sparkSession
    lists = min(int(n**0.5), MAX_LISTS)
    draw = F.xxhash64(F.col("vec_id"), F.lit("sample")).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    sample = rows.filter(draw < SAMPLE * max(lists, LEAST_SAMPLE) / n).dropDuplicates(["vec_id"]).toArrow()
    if not sample.num_rows:
        sample = rows.limit(1).toArrow()
    sample = sample.sort_by("vec_id")
    index = Index(matrix(sample["embedding"].combine_chunks()), sample["vec_id"].to_numpy(), lists, scale)
    sent = spark.sparkContext.broadcast(index)

    def encode(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                some = batch.slice(i, 2048)
                cell, codes, away, off = sent.value.encode(matrix(some.column("embedding")))
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(away), pa.array(off), some.column("embedding")], ["vec_id", "cell", "codes", "away", "off", "x"])

    coded = materialize(rows.mapInArrow(encode, "vec_id long, cell int, codes binary, away double, off double, x array<double>"), "coded")
    sizes = np.zeros(len(index.centres), np.int64)
    for c, size, away in coded.groupBy("cell").agg(F.count(F.lit(1)), F.max("away")).collect():  # MAX_LISTS rows at most
        sizes[c], index.radius[c] = size, away
    whole = spark.sparkContext.broadcast(index)  # with the radius of each list
    first, blocks, at, room, shard = [], [], 0, 0, max(256, min(SHARD, SHARD_BYTES // (8 * dim)))
    for size in sizes.tolist():  # lists share a shard while they fit; a larger list has shards of its own
        if size > shard or room + size > shard:
            at, room = at + (room > 0), 0
        first.append(at)
        blocks.append(max(1, -(-size // shard)))
        at, room = (at + blocks[-1], 0) if size > shard else (at, room + size)
    dealing = spark.createDataFrame([(i, f, b) for i, (f, b) in enumerate(zip(first, blocks, strict=True))], "cell int, first int, blocks int")
    dealt = coded.join(F.broadcast(dealing), "cell").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).cast("int"))

    def spread(batches):
        ix = whole.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                piece = batch.slice(i, 256)
                q = _units(matrix(piece.column("embedding")))
                least = ix.reached(piece.column("vec_id").to_numpy(), q, k)
                shards = [sorted({s for c in np.flatnonzero(p & (sizes > 0)) for s in range(first[c], first[c] + blocks[c])}) for p in ix.probes(q, least)]
                of = np.repeat(np.arange(len(shards)), [len(s) for s in shards])
                some = piece.take(pa.array(of))
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("embedding"), pa.array(least[of]), pa.array([x for s in shards for x in s], pa.int32())], ["vec_id", "x", "off", "shard"])

    sentq = asked.mapInArrow(spread, "vec_id long, x array<double>, off double, shard int")
    none = lambda kind: F.lit(None).cast(kind)
    columns = ["shard", "cell", "vec_id", "codes", "off", "x"]
    met = dealt.select(*columns).unionByName(sentq.withColumns({"cell": none("int"), "codes": none("binary")}).select(*columns))
    met = met.repartition("shard").sortWithinPartitions("shard", F.col("codes").isNull(), "cell", "vec_id")
    found = met.mapInArrow(lambda batches: _scan(whole.value, k)(batches), "query_id long, vec_id long, score double")
    scored = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors with the largest inner product for each row of queries."""
    pick = lambda df: df.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows, asked, size = pick(vectors), pick(queries), F.size("embedding")
    largest = F.max(F.array_max(F.transform("embedding", F.abs)))
    lengths = rows.groupBy(size.alias("dim")).agg(F.count(F.lit(1)).alias("n"), largest.alias("scale"))
    out = None
    # one row for each length of vectors that is asked for
    for dim, n, scale in sorted(map(tuple, lengths.join(asked.select(size.alias("dim")).distinct(), "dim").collect())):
        found = _search(rows.filter(size == dim), asked.filter(size == dim), n, k, dim, scale)
        out = found if out is None else out.unionByName(found)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter(F.col("vec_id") % EVERY == 0))


QUERIES = {"op8_ivf_pq_search": op8}
SQL: dict[str, str] = {}
