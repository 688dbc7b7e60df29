"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number for each key, u in (0, 1), from the MD5 of the key and the shard alone; the shard with the greatest
-weight / ln(u) takes the record. So a shard gets records in proportion to its weight, where a record goes depends
on its key and the weights alone, and a shard that is added, or whose weight grows, takes records only into itself: of n equal shards, one
more moves one record in n + 1. No table of places, no order of rows and no state are needed.

All of it is DataFrame expressions on one row. Only numbering the rows of a shard shuffles, and what is shuffled there are ids and
sums, counted before and dealt by ranges, never by shard (numbering.py). Files of a shard are written by as many tasks as its bytes ask for.

Defined cases: a null key counts as the empty text. Equal keys go to one shard, however many there are; that is the law. A null text has
0 bytes and the CRC of no bytes, 0. Repeated rows get slots of their own. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, crc32_sql, free_name, table
from .numbering import numbered

SHARDS = 24
#: Bytes besides the text that a record takes, and bytes of records that one task writes.
OVERHEAD, FILE_BYTES = 8, 128 << 20
#: Shards that share one MD5: 32 bits of it for each.
DRAWS = 4


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that takes the key. weights: one for each shard; a shard of weight 0 takes nothing."""
    if not any(w > 0 for w in weights) or any(not 0 <= w < float("inf") for w in weights):
        raise ValueError("weights are finite and not negative, and one is above 0")
    key = F.coalesce(key.cast("string"), F.lit(""))
    hashes = F.transform(F.sequence(F.lit(0), F.lit((len(weights) - 1) // DRAWS)), lambda g: F.md5(F.concat(key, F.lit("|"), g.cast("string"))))

    def bids(found: Column) -> Column:
        def bid(i: int, w: float) -> Column:
            draw = F.conv(F.substring(F.get(found, F.lit(i // DRAWS)), 1 + i % DRAWS * 8, 8), 16, 10).cast("double")
            return F.struct((F.lit(-float(w)) / F.ln((draw + 0.5) / float(1 << 32))).alias("bid"), F.lit(-i).alias("shard"))

        return F.array_max(F.array(*(bid(i, w) for i, w in enumerate(weights) if w > 0)))

    # bound as a lambda's variable, the hashes are worked out once and not for each shard; of equal bids the first shard's counts
    return (-F.get(F.transform(F.array(hashes), bids), F.lit(0))["shard"]).cast("int")


def assign(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs with the shard of each row, without a shuffle."""
    return docs.withColumn(name, shard_of(F.col(id_col), weights))


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + OVERHEAD


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write docs as Parquet with a folder for each shard (column `shard`, which docs must not have); returns shard, rows, bytes, files.

    A shard's rows go to as many tasks as its bytes ask for, drawn by key and text, so a shard that holds many
    copies of a key is written by many tasks too.
    """
    if "shard" in docs.columns:
        raise ValueError("docs have a column shard already")
    size, piece = free_name(docs, "size"), free_name(docs, "piece")
    rows = assign(docs, weights, id_col).withColumn(size, record_size(F.col(text_col)))
    sums = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).withColumn("files", F.ceil(F.col("bytes") / file_bytes).cast("int"))
    found = {r["shard"]: r for r in sums.collect()}  # a row for each shard
    if found:
        files = F.element_at(F.create_map(*(F.lit(x) for k, r in found.items() for x in (k, r["files"]))), F.col("shard"))
        # equal rows differ by where they are read, so that copies spread too
        rows = rows.withColumn(piece, F.pmod(F.xxhash64(F.monotonically_increasing_id()), files))
        rows = rows.repartition(sum(r["files"] for r in found.values()), "shard", piece).drop(size, piece)
        rows.write.partitionBy("shard").mode("errorifexists").option("compression", "zstd").parquet(path)
    schema = "shard int, rows long, bytes long, files int"
    return docs.sparkSession.createDataFrame([tuple(r) for _, r in sorted(found.items())], schema)


def moves(docs: DataFrame, old: Sequence[float], new: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """old, new, rows, bytes: what changes of weights, or shards added at the end, carry from shard to shard; rows that stay are there too."""
    key, size = F.col(id_col), record_size(F.col(text_col))
    rows = docs.select(shard_of(key, old).alias("old"), shard_of(key, new).alias("new"), size.alias("size"))
    return rows.groupBy("old", "new").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def placed(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row: its place, and where one more shard of weight 1 would put it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        record_size(F.col(text_col)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(id_col), weights).alias("shard"),
        shard_of(F.col(id_col), [*weights, 1.0]).alias("grown_shard"),
    )
    out = numbered(rows, ["shard"], [F.asc_nulls_first("doc_id"), F.asc("text_crc32"), F.asc("size")], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def _sql() -> str:
    def best(n: int) -> str:
        # all weights are 1: the greatest -1 / ln(u) is the greatest draw
        draws = ", ".join(f"CAST('0x' || substr(m{i // DRAWS}, {1 + i % DRAWS * 8}, 8) AS BIGINT)" for i in range(n))
        return f"CAST(list_position([{draws}], list_max([{draws}])) - 1 AS INT)"

    hashes = ", ".join(f"md5(key || '|{g}') AS m{g}" for g in range(SHARDS // DRAWS + 1))
    return f"""
WITH c AS MATERIALIZED {CRC_TABLE_SQL},
k AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
h AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(strlen(text) + {OVERHEAD} AS BIGINT) AS size, {crc32_sql("text")} AS text_crc32, {hashes} FROM k, c),
s AS (SELECT doc_id, size, text_crc32, {best(SHARDS)} AS shard, {best(SHARDS + 1)} AS grown_shard FROM h)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s"""


QUERIES = {"op13_rendezvous_shards": op13}
SQL = {"op13_rendezvous_shards": _sql()}
