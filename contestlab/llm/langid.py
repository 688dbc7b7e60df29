"""Language identification by prediction by partial matching.

Each language has a byte context tree of order ORDER with the counts of a training sample, frozen. A symbol
seen n times in a context of total t with d different symbols has probability n / (t + d); a symbol not seen
there costs the escape d / (t + d) and is looked for in the context one byte shorter; unseen contexts are
free to leave; below order 0 all 256 bytes are alike. The language with the shortest exact code length of the
whole text wins. Code lengths through all escapes are worked out once for every gram of any tree, so that
scoring a byte is mostly one lookup in numpy for all languages together.

Training takes a bounded sample: texts are cut into blocks of BLOCK bytes, each drawn by a hash of its id and place,
about SAMPLE_BYTES a language, so that long and short texts are met alike. Spark counts the grams of the drawn blocks;
the driver gets the distinct ones, SAMPLE_BYTES a language at most, of the LANGUAGES that have most text (800 MB at the very most; some
10 MB for four languages).
Scoring reads whole texts, the very long ones in pieces.

Defined cases: null texts and texts without a letter are 'und' with score 0; so is every text if there is
nothing to learn from. Ties go to the first language by name. Repeated rows score alike. An empty table gives
an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytegram import PAD, ContextTree, codes_of, mask, merged, pieces, sums_by_text
from .common import crc_mod, slices, table

ORDER, SAMPLE_BYTES, BLOCK, LANGUAGES, HELD_OUT, PIECE = 4, 4 << 20, 4096, 200, 1, 1 << 20


Counts = tuple[np.ndarray, np.ndarray]


def count(blocks: list[bytes], before: list[bytes] | None = None, order: int = ORDER) -> Counts:
    """The distinct grams of the highest order of lower-cased blocks, and how often each occurs."""
    return np.unique(codes_of(blocks, order, before)[0], return_counts=True)


def build(found: dict[str, Counts], order: int = ORDER) -> tuple[list[str], ContextTree]:
    """The languages and one tree with a column of code lengths, in bits, for each. found: the grams of each language."""
    names = sorted(found)
    counted = [found[n] for n in names]
    grams, values, contexts, escapes = [], [], [], []
    floor = 8.0
    for k in range(order + 1):
        keys = np.unique(np.concatenate([g & mask(k + 1) for g, _ in counted]))
        homes, home = np.unique(keys >> np.uint64(8), return_inverse=True)
        n = np.zeros((len(keys), len(names)))
        for i, (g, c) in enumerate(counted):
            np.add.at(n[:, i], np.searchsorted(keys, g & mask(k + 1)), c)
        total, kinds = np.zeros((len(homes), len(names))), np.zeros((len(homes), len(names)))
        np.add.at(total, home, n)
        np.add.at(kinds, home, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0)
            own = np.log2((total + kinds)[home] / n)
        shorter = values[-1][np.searchsorted(grams[-1], keys & mask(k))] if k else floor
        grams.append(keys)
        values.append(np.where(n > 0, own, escape[home] + shorter))
        contexts.append(homes)
        escapes.append(escape)
    return names, ContextTree(grams, values, contexts, escapes, floor)


def train(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, block: int = BLOCK, languages: int = LANGUAGES) -> tuple[list[str], ContextTree] | None:
    """The model of a sample of about sample_bytes of each language's texts that aren't held out; languages: the most that are learnt, those with most text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter((crc_mod(F.col("id"), 3) != HELD_OUT) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    size = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).orderBy(F.desc("size"), "lang").limit(languages)
    share = size.select("lang", (sample_bytes / F.greatest("size", F.lit(1))).alias("share"))

    def grams(batches):
        held = {}
        for batch in batches:
            for piece in slices(batch, 1):
                drawn = {}
                for i, text, lang, part in zip(*(c.to_pylist() for c in (piece.column(0), piece.column(1).cast(pa.binary()), piece.column(2), piece.column(3))), strict=True):
                    low = text.lower()
                    for a in range(0, max(len(low), 1), block):
                        if xxhash.xxh64_intdigest(f"{i}:{a}") < part * 2.0**64:
                            blocks, before = drawn.setdefault(lang, ([], []))
                            blocks.append(low[a : a + block])
                            before.append((bytes([PAD]) * ORDER + low[max(0, a - ORDER) : a])[-ORDER:])
                for lang, found in drawn.items():
                    held.setdefault(lang, []).append(count(*found))
                    if len(held[lang]) > 16:
                        held[lang] = [merged(held[lang])]
        for lang, found in held.items():
            keys, n = merged(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    # no more rows than languages are learnt: sent to the texts, which stay where they are
    counts = rows.join(F.broadcast(share), "lang").select("id", "text", "lang", "share").mapInArrow(grams, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not len(counts):
        return None
    names, gram, n = counts["lang"].to_numpy(), counts["gram"].to_numpy().view(np.uint64), counts["n"].to_numpy()
    return build({x: (gram[names == x], n[names == x]) for x in set(names.tolist())})


def guess(texts: list[str | None], names: list[str], tree: ContextTree) -> tuple[list[str], np.ndarray]:
    raw = [b"" if t is None else t.encode().lower() for t in texts]
    bits = np.zeros((len(raw), len(names)))
    for first, codes, sizes in pieces(raw, tree.order, PIECE):
        bits[first : first + len(sizes)] += sums_by_text(tree.score(codes), sizes)
    best = bits.argmin(axis=1)
    chance = 1 / np.exp2(np.minimum(bits.min(axis=1, keepdims=True) - bits, 0)).sum(axis=1)
    known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
    return [names[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, chance, 0.0)


def identify(docs: DataFrame, model: tuple[list[str], ContextTree] | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, 1):
                texts = piece.column(1).to_pylist()
                langs, scores = guess(texts, *sent.value) if sent.value else (["und"] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), 3) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {"op6_ppm_language": op6}
SQL: dict[str, str] = {}
