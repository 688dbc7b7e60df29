"""Importance resampling towards a target, with a dictionary of distinct features.

Features are runs of 1 to LONGEST words. How much likelier a feature is in the target than in the documents is learnt for
BUCKETS hash buckets; a document weighs as much as its features' mean gain, and a Gumbel draw on top of that picks
documents without replacement.

Each distinct feature is hashed once, whatever its count. Texts are cut into blocks of about BLOCK words. In a block, words are numbered
and features are runs of numbers, sorted and counted by numpy; so a block names each of its features once, however often it holds it.
Names and counts go to bins, by the words' own hash; a bin is the dictionary of its features: it adds up their counts over all blocks, hashes each
name once, and tells each block the buckets of the names that it sent. Buckets' sums, BUCKETS rows, give the gains, and
a block's documents meet the buckets of their features, which are joined back by block.

So what is shuffled is names that are distinct in a block, sorted and compressed, and numbers. A feature in every text is one name for each block: no
feature, hot or not, makes a large group. Bins grow in number with the words (BIN features at most come to one, spread by hash),
and a block holds BLOCK words or one longer text.

Defined cases: words are runs of letters and digits, in which all that isn't ASCII counts as a letter; A-Z are lower-cased. A null text has none. A text
without features weighs 0. A null doc_id draws as empty text and comes first among ties; repeated rows weigh and draw alike and have
ranks of their own. An empty target or table of documents has no features; nothing is divided by that. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, crc32_sql, materialize, slices, table
from .numbering import numbered

LONGEST, BUCKETS, SHARE, LEAST_WORDS, SEED = 2, 10_000, 25, 20, 7
#: Words and texts of a block, features of a bin, blocks of a file.
BLOCK, TEXTS, BIN, RECORDS = 1 << 20, 1 << 16, 1 << 21, 16
#: Each byte lower-cased, and a space for what is in no word.
WORDS = bytes(ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)) + bytes(range(128, 256))


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def packed(a: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of all, compressed."""
    return zstandard.compress(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1).T).view("<u4").ravel()


BLOCKS = "block long, side int, ids array<long>, words int, names binary, sizes binary, text binary"


def _block(number: int, side: int, ids: list, sizes: list, found: list, names: Numbers) -> pa.RecordBatch:
    text = np.concatenate(found) if found else np.zeros(0, np.uint32)
    columns = [pa.array([number]), pa.array([side], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([len(text)], pa.int32())]
    blobs = (zstandard.compress(b"\n".join(names)), packed(np.array(sizes, np.uint32)), packed(text))
    return pa.RecordBatch.from_arrays([*columns, *(pa.array([b], pa.binary()) for b in blobs)], [x.split()[0] for x in BLOCKS.split(", ")])


def _cut(most: int):
    def run(batches):
        """side, id, text to blocks of one side."""
        number, held, so_far = TaskContext.get().partitionId() << 32, {}, {}
        for batch in batches:
            for piece in slices(batch, 2):
                for side, i, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    words = text.translate(WORDS).split() if text else []
                    ids, sizes, found, names = held.setdefault(side, ([], [], [], Numbers()))
                    ids.append(i)
                    sizes.append(len(words))
                    found.append(np.fromiter(map(names.__getitem__, words), np.uint32, len(words)))
                    so_far[side] = so_far.get(side, 0) + len(words)
                    if so_far[side] >= most or len(ids) >= TEXTS:
                        yield _block(number, side, *held.pop(side))
                        number, so_far[side] = number + 1, 0
        for side, one in held.items():
            yield _block(number, side, *one)
            number += 1

    return run


class Features:
    """The distinct features of a block. levels: for runs of 1, 2, ... words, where each run begins and which distinct one it is."""

    def __init__(self, names: bytes, sizes: bytes, text: bytes, longest: int, bins: int):
        plain = zstandard.decompress(names)
        self.words, self.sizes, text = plain.split(b"\n") if plain else [], unpacked(sizes).astype(np.int64), unpacked(text).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        left = np.repeat(self.ends, self.sizes) - np.arange(len(text))  # words from each on, in its text
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        at, which, ends, mixed = np.arange(len(text)), text, np.arange(len(self.words))[:, None], hashes
        counts = np.bincount(text, minlength=len(self.words))
        self.levels, self.parts, self.counts, of = [], [], [], []
        for k in range(1, longest + 1):
            if k > 1:
                keep = left[at] >= k
                at = at[keep]
                runs, which, counts = np.unique(which[keep] << 32 | text[at + k - 1], return_inverse=True, return_counts=True)
                ends = np.column_stack([ends[runs >> 32], runs & 0xFFFFFFFF])
                mixed = (mixed[runs >> 32] * np.uint64(0x9E3779B97F4A7C15) + hashes[runs & 0xFFFFFFFF]) ^ np.uint64(k)
            self.levels.append((at, which))
            self.parts.append(ends)
            self.counts.append(counts)
            of.append((mixed >> np.uint64(20)) % np.uint64(bins))
        self.bin = np.concatenate(of).astype(np.int64)
        self.order = np.argsort(self.bin, kind="stable")

    def sent(self):
        """bin, names, counts for each bin."""
        words = pa.array(self.words, pa.large_binary())
        last = pc.binary_join_element_wise(words, pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary())) if self.words else words
        named = []
        for parts in self.parts:
            columns = [words.take(pa.array(p)) for p in parts.T[:-1]] + [last.take(pa.array(parts[:, -1]))]
            named.append(pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())) if len(columns) > 1 else columns[0])
        named = pa.concat_arrays(named).take(pa.array(self.order))
        counts, bins = np.concatenate(self.counts)[self.order], self.bin[self.order]
        edges = np.flatnonzero(np.diff(bins, prepend=-1, append=-1)) if len(bins) else np.zeros(0, np.int64)
        _, offsets, data = named.buffers()
        offsets = np.frombuffer(offsets, np.int64)[named.offset :]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(bins[a]), zstandard.compress(data[offsets[a] : offsets[b]]), packed(counts[a:b])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum over its features; values: of the distinct features, level by level in order of bins."""
        own = np.empty(len(values), np.int64)
        own[self.order] = values
        total, begun = np.zeros(int(self.sizes.sum()) + 1, np.int64), 0
        for (at, which), parts in zip(self.levels, self.parts, strict=True):
            total[at + 1] += own[begun : begun + len(parts)][which]
            begun += len(parts)
        total = np.cumsum(total)
        return total[self.ends] - total[self.ends - self.sizes]


def _send(longest: int, bins: int):
    def run(batches):
        for batch in batches:
            for block, side, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(Features(*blobs, longest, bins).sent())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([side] * len(rows), pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], ["bin", "block", "side", "names", "counts"])

    return run


def _names(blob: bytes) -> pa.BinaryArray:
    """The names, each with its end of line."""
    data = zstandard.decompress(blob)
    offsets = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


HOMES = "block long, bin int, buckets binary, counts array<long>, target array<long>"


def _dictionary(n: int):
    """The dictionary of one bin: for each block of documents the buckets of its names, and one row of buckets' sums."""

    def run(group: pa.Table) -> pa.Table:
        sides = group["side"].to_numpy()
        sent = [_names(b) for b in group["names"].to_pylist()]
        coded = pa.concat_arrays(sent).dictionary_encode()
        which, ends = coded.indices.to_numpy(), np.cumsum([len(x) for x in sent])
        bucket = np.fromiter((zlib.crc32(x[:-1]) % n for x in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        sums, homes = np.zeros((2, n), np.int64), []
        for b, e, size, side, counts in zip(group["block"].to_pylist(), ends, map(len, sent), sides, group["counts"].to_pylist(), strict=True):
            own = bucket[which[e - size : e]]
            np.add.at(sums[side], own, unpacked(counts).astype(np.int64))
            if side == 0:
                homes.append((b, packed(own)))
        rows = len(homes) + 1
        longs = pa.list_(pa.int64())
        return pa.Table.from_arrays(
            [pa.array([h[0] for h in homes] + [None], pa.int64()), pa.array([group["bin"][0].as_py()] * rows, pa.int32()), pa.array([h[1] for h in homes] + [None], pa.binary()), *(pa.array([None] * len(homes) + [s], longs) for s in sums)],
            [x.split()[0] for x in HOMES.split(", ")],
        )

    return run


def gains(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, in thousandths: log of its smoothed share in the target over that in the documents."""
    n = len(counts)
    return np.floor(1000 * np.log((target + 1.0) * (counts.sum() + float(n)) / ((counts + 1.0) * (target.sum() + float(n))))).astype(np.int64)


WEIGHTS = "doc_id long, n_words long, n_features long, weight long"


def _weigh(longest: int, bins: int, gain: np.ndarray):
    def run(batches):
        for batch in batches:
            for ids, names, sizes, text, homes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Features(names, sizes, text, longest, bins)
                found = [unpacked(h["buckets"]) for h in sorted(homes or [], key=lambda h: h["bin"])]
                sums = own.sums(gain[np.concatenate(found)] if found else np.zeros(0, np.int64))
                n = sum(np.maximum(own.sizes - k, 0) for k in range(longest))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (own.sizes, n, sums // np.maximum(n, 1)))], [x.split()[0] for x in WEIGHTS.split(", ")])

    return run


def weights(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bin_size: int = BIN) -> DataFrame:
    """doc_id, n_words, n_features, weight for each row of docs: the mean gain of its features, in thousandths of a nat."""
    rows = docs.select(F.lit(0).alias("side"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.unionByName(target.select(F.lit(1).alias("side"), F.lit(None).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    blocks = materialize(rows.mapInArrow(_cut(block), BLOCKS), "blocks", records=RECORDS)
    bins = max(1, -(-(blocks.agg(F.sum(F.col("words").cast("long"))).first()[0] or 0) * longest // bin_size))
    sent = blocks.select("block", "side", "names", "sizes", "text").mapInArrow(_send(longest, bins), "bin int, block long, side int, names binary, counts binary")
    homes = materialize(sent.groupBy("bin").applyInArrow(_dictionary(buckets), HOMES), "homes")
    sums = homes.filter("block is null").select(F.posexplode(F.arrays_zip("counts", "target"))).groupBy("pos").agg(F.sum("col.counts").alias("s"), F.sum("col.target").alias("t"))
    found = np.zeros((2, buckets), np.int64)
    for r in sums.collect():  # no more rows than buckets
        found[:, r.pos] = r.s, r.t
    back = homes.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("bin", "buckets")).alias("homes"))
    met = blocks.filter("side = 0").join(back, "block", "left").select("ids", "names", "sizes", "text", "homes")
    return met.mapInArrow(_weigh(longest, bins, gains(*found)), WEIGHTS)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: the highest scores of share percent of all documents of least_words words have ranks from 1."""
    rows = materialize(weights(docs, target, longest, buckets), "weights")
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.ln(-F.ln((draw + 0.5) / 4294967296.0)))
    rows = rows.withColumn("score", score.cast("long"))
    fit, names = F.col("n_words") >= least_words, ("doc_id", "n_features", "weight", "score")
    most = share * rows.filter(fit).count() // 100
    ranked = numbered(rows.filter(fit).select(*names), [], [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < most, F.col("rank") + 1))
    return ranked.unionByName(rows.filter(~fit).select(*names, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs that resample() draws, with their rank; doc_id must be unique."""
    ranks = resample(docs, target, **how).filter("rank is not null").select(F.col("doc_id").alias("drawn_id"), "rank")
    return docs.join(ranks, docs["doc_id"].cast("long") == ranks["drawn_id"]).select(docs["*"], "rank")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


def _sql() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = "ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])"
    return f"""
WITH c AS MATERIALIZED {CRC_TABLE_SQL},
d AS MATERIALIZED (SELECT row_number() OVER () AS k, CAST(doc_id AS BIGINT) AS doc_id, {words} AS ws FROM documents),
f AS MATERIALIZED (SELECT k, x, count(*) AS n FROM (SELECT k, unnest({runs}) AS x FROM d) GROUP BY 1, 2),
b AS (SELECT x, count(*) AS n FROM (SELECT unnest({runs}) AS x FROM (SELECT {words} AS ws FROM benchmark)) GROUP BY 1),
dictionary AS MATERIALIZED (SELECT x, {crc32_sql("x")} % {BUCKETS} AS bucket, s, t FROM (SELECT x, coalesce(s, 0) AS s, coalesce(b.n, 0) AS t FROM (SELECT x, sum(n) AS s FROM f GROUP BY 1) FULL JOIN b USING (x)), c),
sums AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM dictionary GROUP BY 1),
whole AS (SELECT sum(s) AS ss, sum(t) AS tt FROM sums),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (ss + {BUCKETS}) / ((s + 1) * (tt + {BUCKETS})))) AS BIGINT) AS gain FROM sums, whole),
w AS (SELECT k, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS g FROM f JOIN dictionary USING (x) JOIN gains USING (bucket) GROUP BY 1),
r AS (SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, CAST(coalesce((g - ((g % n) + n) % n) // n, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (k)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= (SELECT {SHARE} * count(*) // 100 FROM r WHERE n_words >= {LEAST_WORDS}) THEN place END AS rank FROM ranked"""


QUERIES = {"op11_feature_resampling": op11}
SQL = {"op11_feature_resampling": _sql()}
