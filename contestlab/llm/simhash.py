"""SimHash near-duplicates found by pigeonring filtering.

The 64 bits are cut into a ring of three segments (22, 21, 21 bits). For two fingerprints that differ in at
most 2 bits, the pigeonring principle promises a start i whose chain keeps to the proportional budgets
floor(l * 2 / 3): the first segment differs in 0 bits, the first two together in at most 1, all three in at
most 2. The join key uses the chain itself: segment i whole, and one half of segment i+1 (with one
difference at most in it, one of its halves is equal). Each fingerprint has six such keys of about 32 bits,
and the rest of the chain and the full Hamming distance are tested inside the join.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other. Rows with a null
doc_id take part and keep their null id; ids of components are the least id that isn't null. Repeated rows
come out as often as they went in.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, table
from .graph import connected_components

SEED, BITS = 42, 2
#: (shift, width) of the ring's segments.
RING = ((42, 22), (21, 21), (0, 21))
CHUNK = 1 << 16


def _count_bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def hashes(text: bytes | None, width: int = 3) -> np.ndarray:
    """The hashes of the text's shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts, h = [0, *(e + 1 for e in ends)], xxhash.xxh64_intdigest
    spans = zip(starts, ends[min(width, len(words)) - 1 :], strict=False)
    return np.fromiter((h(line[a:b], SEED) for a, b in spans), np.uint64, max(1, len(words) - width + 1))


def majority(found: np.ndarray) -> int:
    """The unsigned 64 bits that are set in over half the hashes; zero if there are none."""
    counts = sum((_count_bits(found[i : i + CHUNK]) for i in range(0, len(found), CHUNK)), np.zeros(64, np.int64))
    return sum(1 << b for b in np.flatnonzero(2 * counts > len(found)).tolist())


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text; zero if it has no words."""
    return majority(hashes(text, width))


def _fingerprints(batches):
    for batch in batches:
        fps = np.array([fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def _part(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _chain_keys(fps: DataFrame) -> DataFrame:
    """fp, key, at: six chain keys for each fingerprint; at: the segment where the chain starts."""
    fp, keys = F.col("fp"), []
    for i, (shift, width) in enumerate(RING):
        s, w = RING[(i + 1) % 3]
        for half, (hs, hw) in enumerate(((s, w // 2), (s + w // 2, w - w // 2))):
            key = F.shiftleft(F.shiftleft(_part(fp, shift, width), 11).bitwiseOR(_part(fp, hs, hw)), 3).bitwiseOR(F.lit(2 * i + half))
            keys.append(F.struct(key.alias("key"), F.lit(i).alias("at")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.key", "k.at")


def links(fps: DataFrame) -> DataFrame:
    """u, v: all pairs of different fingerprints with at most two differing bits."""
    a, b = _chain_keys(fps).alias("a"), _chain_keys(fps).alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    second = F.lit(0)
    for i in range(3):
        second = F.when(F.col("a.at") == i, F.bit_count(_part(x, *RING[(i + 1) % 3]))).otherwise(second)
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (second <= 1) & (F.bit_count(x) <= BITS)
    return a.join(b, near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id reachable by links of at most two bits."""
    marked = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    parts = connected_components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    joined = classes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = joined.join(least, "component").select("fp", "component_id")
    return marked.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """The columns of docs for one row of each near-duplicate group: the row whose id is the group's.

    groups: doc_id, component_id of each row, by default those of near_duplicates. Of repeated rows with one id, one stays. Rows with a null id stay only if their group has no id.
    """
    key, place = free_name(docs, "near_key"), free_name(docs, "near_place")
    # ids as text, so that a null id has a key of its own; the join and the window share one shuffle by it
    as_key = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(""))
    groups = near_duplicates(docs, id_col, text_col) if groups is None else groups
    keepers = groups.filter("doc_id <=> component_id").select(as_key("doc_id").alias(key)).distinct()
    kept = docs.withColumn(key, as_key(id_col)).join(keepers, key, "left_semi")
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(F.col(text_col).cast("string"))))
    return kept.withColumn(place, first).filter(F.col(place) == 1).select(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash_pigeonring": op1}
SQL: dict[str, str] = {}
