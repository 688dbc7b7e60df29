"""SimHash near-duplicates of five-word shingles, completed to a Jaccard similarity of 0.8, for the pipeline.

SimHash comes first: fingerprints of the five-word shingles are linked by the pigeonring chains of operator 1, and each
pair of texts found so is compared exactly. That catches what differs in a few words of many. But at a similarity of
0.8 two 64-bit SimHashes differ in about 10 bits, and a budget that wide makes candidates of a fixed share of all pairs, whatever
the keys of the join. So what SimHash leaves apart is looked for by MinHash: BANDS keys of ROWS minima each, of
which two texts of similarity s share one with probability 1 - (1 - s**ROWS)**BANDS, 0.9996 at 0.8. Each candidate is
compared exactly too; nothing is linked on a hash alone.

A bucket is not paired in full. Its members are first compared with its least one; what that links is one component,
inside which no further pair can change a result. A large group of near copies so costs about one comparison a member.
Of a bucket whose texts are still in different components after that, all pairs across components are compared if it has no more than PAIRED
texts, at most PAIRED / 2 a text. In larger ones, a component of more than PAIRED texts is a crowd: the texts of its buckets that are still beside it, often just below
the threshold, meet it in blocks of CROWD by BESIDE texts, and a block gives one link a text at most, however many pairs it compares.
All others, often many of one template that aren't near, are matched by prefixes, which loses nothing:
with the shingles of all texts in one order, rarest first, two texts of a similarity of at least t share one among the first
(1 - t) n + 1 of the longer and the first (1 - t) / (1 + t) n + 1 of the shorter, and no later in either than the overlap that they need
allows. What texts have of their own is rarer than their template, so those that are not near meet nowhere. The order is by
counts in SLOTS hash slots; any order would give the same pairs.

Defined cases: texts are words, lower-cased (A-Z); one of fewer words than a shingle is one shingle. Null, empty and
blank texts are alike. Rows with a null id take part; ids of components are the least id that isn't null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components
from .simhash import hashes, links, majority

SEED, WIDTH, LEAST, BANDS, ROWS = 42, 5, 0.8, 26, 6
PAIRED, SLOTS = 64, 1 << 18
#: Texts of a crowd, and texts beside it, that one task compares.
CROWD, BESIDE = 512, 128
CHUNK = 1 << 12
_rng = np.random.default_rng(SEED)
FLIP = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
TIMES = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    return np.unique(hashes(text, width))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band."""
    least = np.full(len(FLIP), np.iinfo(np.uint64).max)
    for a in range(0, len(hashes), CHUNK):
        least = np.minimum(least, ((hashes[a : a + CHUNK, None] ^ FLIP) * TIMES).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64)


def _sketch(width: int):
    def run(batches):
        for batch in batches:
            n, fp, bands = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                found = hashes(text, width)
                fp.append(majority(found))
                found = np.unique(found)
                n.append(len(found))
                bands.append(band_keys(found))
            keys = np.concatenate(bands) if bands else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), lists], ["doc_id", "key", "n", "fp", "bands"])

    return run


def _verify(width: int, least: float):
    def run(batches):
        for batch in batches:
            u, v = (c.to_pylist() for c in batch.columns[:2])
            a, b = (c.cast(pa.binary()).to_pylist() for c in batch.columns[2:])
            last, sets, near = None, None, []
            for i in range(len(u)):
                if u[i] != last:
                    last, sets = u[i], shingles(a[i], width)
                if jaccard(sets, shingles(b[i], width)) >= least:
                    near.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in near], pa.int64()) for x in (u, v)], ["u", "v"])

    return run


def _slot_counts(width: int):
    def run(batches):
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts += np.bincount((shingles(text, width) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["slot", "n"])

    return run


PREFIXES = "token long, key long, part long, n int, at int, short boolean"


def _prefixes(width: int, least: float, counts: np.ndarray):
    def run(batches):
        for batch in batches:
            rows = []
            for key, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                found = shingles(text, width)
                found = found[np.lexsort((found, counts[(found % np.uint64(SLOTS)).astype(np.int64)]))]
                n = len(found)
                long = n - int(np.ceil(least * n - 1e-9)) + 1
                short = n - int(np.ceil(2 * least / (1 + least) * n - 1e-9)) + 1
                at = np.arange(min(long, n))
                rows.append((found[at].view(np.int64), np.full(len(at), key, np.int64), np.full(len(at), part, np.int64), np.full(len(at), n, np.int32), at.astype(np.int32), at < short))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], [x.split()[0] for x in PREFIXES.split(", ")])

    return run


def prefix_pairs(texts: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """u, v: pairs of keys of texts (key, text, part) of different parts, among them all of a similarity of at least `least`."""
    slots = texts.select("text").mapInArrow(_slot_counts(width), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(SLOTS, np.int64)
    for r in slots.collect():  # no more rows than slots
        counts[r.slot] = r.n
    rows = materialize(texts.select("key", "part", "text").mapInArrow(_prefixes(width, least, counts), PREFIXES), "prefixes")
    a, b = rows.filter("short").alias("a"), rows.alias("b")
    left = lambda x: F.col(f"{x}.n") - F.col(f"{x}.at")
    need = F.lit(least / (1 + least)) * (F.col("a.n") + F.col("b.n")) - F.lit(1e-9)
    # the first shingle that two texts share stands early enough in both for the overlap that they need
    fits = (F.col("a.n") <= F.col("b.n")) & (F.col("a.n") >= F.col("b.n") * F.lit(least) - F.lit(1e-9)) & (F.col("a.part") != F.col("b.part")) & (F.least(left("a"), left("b")) >= need)
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & fits)
    return pairs.select(F.least("a.key", "b.key").alias("u"), F.greatest("a.key", "b.key").alias("v")).distinct()


def _beside(width: int, least: float):
    def run(group: pa.Table) -> pa.Table:
        side, keys = group["side"].to_numpy(), group["key"].to_numpy()
        texts = group["text"].cast(pa.binary()).to_pylist()
        mine = [n for n in np.argsort(keys, kind="stable").tolist() if side[n] == 0]
        sets = [shingles(texts[n], width) for n in mine]
        sizes = np.array([len(x) for x in sets], np.int64)
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner, found = tokens[order], owner[order], []
        for n in np.flatnonzero(side == 1).tolist():
            own = shingles(texts[n], width)
            first, last = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
            many = last - first
            at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            shared = np.bincount(owner[at], minlength=len(sets))
            near = np.flatnonzero(shared >= least * (sizes + len(own) - shared))
            if len(near):  # the crowd is one component: one link says it all
                found.append((int(keys[mine[near[0]]]), int(keys[n])))
        return pa.table({"u": pa.array([min(x) for x in found], pa.int64()), "v": pa.array([max(x) for x in found], pa.int64())})

    return run


def crowd_links(hard: DataFrame, crowds: DataFrame, texts: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """u, v: for each text of hard (band, key, part) beside a crowd (part, members) with which it shares a band, links to the crowd if any text of it is near."""
    there = hard.join(crowds.select("part"), "part").select("band", F.col("part").alias("crowd")).distinct()
    met = hard.join(there, "band").filter("part != crowd").join(crowds, "part", "left")
    # of two crowds the one of the lesser number stands beside the other
    met = materialize(met.filter(F.col("members").isNull() | (F.col("part") < F.col("crowd"))).select("crowd", "key").distinct(), "beside")
    blocks = met.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / BESIDE).cast("int").alias("others"))
    blocks = blocks.join(crowds.select(F.col("part").alias("crowd"), F.ceil(F.col("members") / CROWD).cast("int").alias("blocks")), "crowd")
    deal = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = hard.select(F.col("part").alias("crowd"), "key").distinct().join(blocks, "crowd").withColumn("i", deal(F.col("blocks"))).select("crowd", "i", each(F.col("others")).alias("j"), F.lit(0).alias("side"), "key")
    other = met.join(blocks, "crowd").withColumn("j", deal(F.col("others"))).select("crowd", each(F.col("blocks")).alias("i"), "j", F.lit(1).alias("side"), "key")
    rows = mine.unionByName(other).join(texts, "key").select("crowd", "i", "j", "side", "key", "text")
    return materialize(rows.groupBy("crowd", "i", "j").applyInArrow(_beside(width, least), "u long, v long"), "linked")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """doc_id, component_id for each row: the least doc_id reachable by links of texts with a Jaccard similarity of at least `least`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    marked = materialize(rows.mapInArrow(_sketch(width), "doc_id long, key long, n long, fp long, bands array<long>"), "sketches")
    # one row a text: copies of one are counted off here, before anything is joined
    one = lambda c: F.first(c).alias(c)
    classes = materialize(marked.groupBy("key").agg(one("n"), one("fp"), one("bands"), F.min("doc_id").alias("first_id")), "classes")
    spots = classes.select("key", "n", F.explode("bands").alias("band"))
    buckets = spots.groupBy("band").agg(F.min(F.struct("key", "n")).alias("lead"), F.max("key").alias("last")).filter("lead.key < last")
    members = materialize(spots.join(buckets.select("band", "lead"), "band").select("band", "key", "n", "lead").distinct(), "members")
    sized = lambda a, b: F.least(a, b) >= F.greatest(a, b) * F.lit(least)

    # the texts of one fingerprint with the least of them, and the least ones of two that are linked
    prints = classes.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("lead"), F.max("key").alias("last"))
    same = classes.select("fp", F.struct("key", "n").alias("own")).join(prints.filter("lead.key < last"), "fp").select(F.col("lead").alias("a"), F.col("own").alias("b"))
    lead = lambda end, name: prints.select(F.col("fp").alias(end), F.col("lead").alias(name))
    other = links(prints.select("fp")).join(lead("u", "a"), "u").join(lead("v", "b"), "v").select("a", "b")
    close = same.unionByName(other).filter("a.key != b.key").filter(sized(F.col("a.n"), F.col("b.n")))
    close = materialize(close.select(F.least("a.key", "b.key").alias("u"), F.greatest("a.key", "b.key").alias("v")).distinct(), "close")

    need = members.select("key").union(close.select("u")).union(close.select("v")).distinct()
    need = materialize(need, "need")
    texts = materialize(rows.select("key", "text").join(need, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")), "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("key").alias("v"), F.col("text").alias("b")), "v").join(texts.select(F.col("key").alias("u"), F.col("text").alias("a")), "u")
        return materialize(both.select("u", "v", "a", "b").mapInArrow(_verify(width, least), "u long, v long"), "near")

    near = linked(close)
    stars = members.filter(F.col("key") > F.col("lead.key")).filter(sized(F.col("n"), F.col("lead.n"))).select(F.col("lead.key").alias("u"), F.col("key").alias("v")).distinct()
    stars = materialize(stars.join(close, ["u", "v"], "left_anti"), "stars")
    near = near.unionByName(linked(stars))
    parts = connected_components(near).select(F.col("node").alias("key"), "component")
    split = members.join(parts, "key", "left").select("band", "key", "n", F.coalesce("component", "key").alias("part"))
    mixed = split.groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("band")
    split = materialize(split.join(mixed, "band", "left_semi"), "split")
    sizes = split.groupBy("band").agg(F.count(F.lit(1)).alias("members"))
    large = sizes.filter(F.col("members") > PAIRED).select("band")
    hard = materialize(split.join(large, "band", "left_semi").select("band", "key", "part"), "hard")
    split = split.join(large, "band", "left_anti")
    own = hard.select("key", "part").distinct()
    crowds = materialize(own.groupBy("part").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > PAIRED), "crowds")
    beside = crowd_links(hard, crowds, texts, width, least)
    scattered = texts.join(own.join(crowds, "part", "left_anti"), "key")
    sides = split.select("band", "part").distinct()
    sides = sides.select("band", F.col("part").alias("p")).join(sides.select("band", F.col("part").alias("q")), "band").filter("p < q")
    one, two = (split.select("band", F.col("part").alias(p), F.col("key").alias(f"k{p}"), F.col("n").alias(f"n{p}")) for p in "pq")
    cross = sides.join(one, ["band", "p"]).join(two, ["band", "q"]).filter(sized(F.col("np"), F.col("nq"))).select("kp", "kq")
    cross = cross.unionByName(prefix_pairs(scattered, width, least).select(F.col("u").alias("kp"), F.col("v").alias("kq")))
    cross = cross.select(F.least("kp", "kq").alias("u"), F.greatest("kp", "kq").alias("v")).distinct().join(stars.unionByName(close), ["u", "v"], "left_anti")
    parts = connected_components(near.unionByName(beside).unionByName(linked(cross))).select(F.col("node").alias("key"), "component")

    classes = classes.select("key", "first_id").join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    heads = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = classes.join(heads, "component").select("key", "component_id")
    return marked.select("doc_id", "key").join(found, "key").select("doc_id", "component_id")
