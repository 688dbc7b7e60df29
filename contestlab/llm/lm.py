"""Language-model scores from a probabilistic suffix tree over bytes.

A text's tokens are its words, lower-cased (A-Z), and one end; their symbols are the word's bytes and a space,
or one newline. The tree's states are contexts of up to ORDER bytes. Counts come from all training texts: grams are counted in each task and summed by
Spark. A state keeps its frequent symbols (the method's least probability: GRAM_SHARE of all symbols, a parameter), each with its count less a
discount; the rest of its mass goes to its parent, the longest shorter state, so every state is a proper
distribution. A context becomes a state only if it passes a divergence test: the log-likelihood that its own
distribution gains over its parent's must be MIN_GAIN for each of the count that a frequent gram needs. A text is scored from its
longest suffix states. A token is spelled by its symbols from there with weight 1 - ROOT, and with weight
ROOT it comes from the empty context of whole tokens, smoothed by one and with one symbol for all unknown
ones, as in the base score. The score is the text's log10 probability.

Both need each word's exact count. Words with at least HEAD_SHARE of all tokens are sent to every task; all
the others meet the counts in a join, keyed by word, so no vocabulary is ever gathered.

Bounds: a share s of the corpus can be reached by no more than 1/s grams of one order, or words; that bounds
what is collected to assemble the tree and what is broadcast, at any size of the corpus, and no count of the
corpus is dropped: rarer grams are in their contexts' totals and their shorter grams.

Defined cases: a null text is empty: one token, its end. A null id counts as id ''. Repeated rows are learned
from and scored each time. Without training texts N = V = 0 and all bytes are alike. An empty table gives an
empty table.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytegram import PAD, ContextTree, codes_of, mask, merged, sums_by_text
from .common import crc_mod, materialize, slices, table

ORDER, HELD_OUT, ROOT = 5, 2, 0.25
HEAD_SHARE, GRAM_SHARE, MIN_GAIN, DISCOUNT, FLOOR = 1e-6, 5e-7, 1.0, 0.75, 0.5
PIECE, WORDS_HELD, GRAMS_HELD, CHUNK = 1 << 19, 200_000, 1_000_000, 100_000


def _runs(lists: list[list[bytes]]):
    """Runs of token lists as (text number of each chunk, chunks of tokens, codes, symbols of each chunk).

    A long text comes in chunks; each knows the bytes before it. Tokens are words and END.
    """
    start, number, chunks, texts, before, size = bytes([PAD]) * ORDER, [], [], [], [], 0
    for i, row in enumerate(lists):
        tail = start
        for a in range(0, len(row), CHUNK):
            some = row[a : a + CHUNK]
            text = b" ".join(some[:-1] + [b"\n"] if some[-1] == b"\n" else some + [b""])
            number.append(i)
            chunks.append(some)
            texts.append(text)
            before.append(tail)
            tail, size = (tail + text[-ORDER:])[-ORDER:], size + len(text)
            if size > PIECE:
                yield number, chunks, *codes_of(texts, ORDER, before)
                number, chunks, texts, before, size = [], [], [], [], 0
    if texts:
        yield number, chunks, *codes_of(texts, ORDER, before)


def _tokens(batch: pa.RecordBatch, column: int):
    for piece in slices(batch, column):
        yield piece, [[*(t or b"").lower().split(), b"\n"] for t in piece.column(column).cast(pa.binary()).to_pylist()]


def _count(batches):
    """Partial counts of a task: word, n or gram, n. Held counts are let go when they fill their room."""
    words, grams, held = Counter(), [], 0

    def rows(word, gram, n):
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], ["word", "gram", "n"])

    def out_words():
        items = list(words.items())
        for i in range(0, len(items), 50_000):
            some = items[i : i + 50_000]
            yield rows([w.decode("utf-8", "replace") for w, _ in some], [None] * len(some), [n for _, n in some])
        words.clear()

    def out_grams(keys, n):
        for i in range(0, len(keys), 200_000):
            yield rows([None] * len(keys[i : i + 200_000]), keys[i : i + 200_000].view(np.int64), n[i : i + 200_000])

    for batch in batches:
        for _, lists in _tokens(batch, 0):
            for row in lists:
                words.update(row)
            if len(words) > WORDS_HELD:
                yield from out_words()
            for _, _, codes, _ in _runs(lists):
                grams.append(np.unique(codes, return_counts=True))
                held += len(grams[-1][0])
            if held > GRAMS_HELD:
                grams = [merged(grams)]
                if (held := len(grams[0][0])) > GRAMS_HELD // 2:
                    yield from out_grams(*grams[0])
                    grams, held = [], 0
    yield from out_words()
    if grams:
        yield from out_grams(*merged(grams))


def _levels(counts: DataFrame) -> DataFrame:
    """order, context (whether it is a context or a gram), code, n: counts of all orders from those of the highest."""
    gram, rows = F.col("gram"), []
    for k in range(ORDER + 1):
        low = lambda c, m: c.bitwiseAND(F.lit((1 << (8 * m)) - 1))
        rows.append(F.struct(F.lit(k).alias("order"), F.lit(False).alias("context"), low(gram, k + 1).alias("code")))
        rows.append(F.struct(F.lit(k).alias("order"), F.lit(True).alias("context"), low(F.shiftrightunsigned(gram, 8), k).alias("code")))
    return counts.filter("gram is not null").select(F.explode(F.array(*rows)).alias("r"), "n").groupBy("r.order", "r.context", "r.code").agg(F.sum("n").alias("n"))


def assemble(levels: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]], total: int, least: float) -> ContextTree:
    """The suffix tree of log10 probabilities. levels: codes and counts of frequent grams and contexts; total: symbols of the corpus."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    floor = float(np.log10(FLOOR / (total + 256 * FLOOR)))
    grams, values, contexts, escapes = [], [], [], []
    for k in range(ORDER + 1):
        keys, n = levels.get((k, False), none)
        homes, totals = levels.get((k, True), none)
        if k == 0:
            grams.append(keys)
            values.append(np.log10((n + FLOOR) / (total + 256 * FLOOR))[:, None])
            contexts.append(np.zeros(0, np.uint64))
            escapes.append(np.zeros((0, 1)))
            continue
        home = np.searchsorted(homes, keys >> np.uint64(8))
        parent = values[-1][np.searchsorted(grams[-1], keys & mask(k)), 0] if len(keys) else np.zeros(0)
        own, seen = n - DISCOUNT, np.zeros(len(homes))
        np.add.at(seen, home, own)
        rest = totals - seen
        value = np.log10((own + rest[home] * 10**parent) / totals[home]) if len(keys) else parent
        gain, kept = np.zeros(len(homes)), np.zeros(len(homes))
        np.add.at(gain, home, n * (value - parent))
        np.add.at(kept, home, n)
        escape = np.log10(rest / totals)
        state = (kept > 0) & (gain + (totals - kept) * escape >= MIN_GAIN * least / np.log(10))
        grams.append(keys)
        values.append(np.where(state[home], value, parent)[:, None])
        contexts.append(homes[state])
        escapes.append(escape[state][:, None])
    return ContextTree(grams, values, contexts, escapes, floor)


def learn(docs: DataFrame, least_share: float = GRAM_SHARE) -> tuple[DataFrame, dict, ContextTree]:
    """words (word, n); sizes and head counts; the tree. least_share: of all symbols, the least that a gram of the tree has."""
    known = docs.filter(crc_mod(F.col("doc_id").cast("long"), 7) != HELD_OUT).select(F.col("text").cast("string").alias("text"))
    counts = materialize(known.mapInArrow(_count, "word string, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n")), "counts")
    words = counts.filter("word is not null").select("word", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head = words.filter(F.col("n") >= HEAD_SHARE * n).toArrow()
    symbols = counts.filter("gram is not null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1.0, least_share * symbols)
    found = _levels(counts).filter(F.col("n") >= least).toArrow()
    order, context = found["order"].to_numpy(), found["context"].to_numpy(zero_copy_only=False)
    code, count, levels = found["code"].to_numpy().view(np.uint64), found["n"].to_numpy(), {}
    for k in range(ORDER + 1):
        for c in (False, True):
            own = np.flatnonzero((order == k) & (context == c))
            own = own[np.argsort(code[own])]
            levels[k, c] = code[own], count[own]
    sizes = {"n": n, "v": v, "head": dict(zip(head["word"].cast(pa.binary()).to_pylist(), head["n"].to_pylist(), strict=True))}
    return words, sizes, assemble(levels, symbols, least)


def score(docs: DataFrame, words: DataFrame, sizes: dict, tree: ContextTree) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    sent, lost = docs.sparkSession.sparkContext.broadcast((sizes["head"], tree)), float(np.log10(sizes["n"] + sizes["v"] + 1))
    space = float(sizes["n"] + sizes["v"] + 1)
    fields = "key long, doc_id long, word string, spelled double, n_tokens long, n_known long, base double, score double"

    def run(batches):
        head, model = sent.value
        part, at = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for piece, lists in _tokens(batch, 1):
                rows, out = len(lists), [[] for _ in range(8)]
                known, base, prob = np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
                rare = [([], []) for _ in lists]
                for number, chunks, codes, _ in _runs(lists):
                    flat = list(chain.from_iterable(chunks))
                    symbols = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
                    symbols[[w == b"\n" for w in flat]] = 1
                    spelled = 10 ** np.add.reduceat(model.score(codes)[:, 0], np.cumsum(symbols) - symbols, dtype=np.float64).clip(-300)
                    count = np.fromiter((head.get(w, 0) for w in flat), np.int64, len(flat))
                    seen = count > 0
                    sizes_of = np.fromiter(map(len, chunks), np.int64)
                    number = np.array(number)
                    for into, values in ((known, seen), (base, np.where(seen, np.log10(count + 1) - lost, 0)), (prob, np.where(seen, np.log10(ROOT * (count + 1) / space + (1 - ROOT) * spelled), 0))):
                        np.add.at(into, number, sums_by_text(values.astype(np.float64), sizes_of).astype(into.dtype))
                    text = np.repeat(number, sizes_of)
                    where = np.flatnonzero(~seen)
                    for j, of, p in zip(where.tolist(), text[where].tolist(), spelled[where].tolist(), strict=True):
                        rare[of][0].append(flat[j])
                        rare[of][1].append(p)
                for i, (doc_id, row) in enumerate(zip(piece.column(0).to_pylist(), lists, strict=True)):
                    # the text's own row carries its key as a word that no text has: a space, then the key
                    own = (part + at, doc_id, f" {part + at}", None, len(row), int(known[i]), float(base[i]), float(prob[i]))
                    for column, value in zip(out, own, strict=True):
                        column.append(value)
                    n = len(rare[i][0])
                    out[0] += [part + at] * n
                    out[1] += [doc_id] * n
                    out[2] += [w.decode("utf-8", "replace") for w in rare[i][0]]
                    out[3] += rare[i][1]
                    for column in out[4:]:
                        column += [0] * n
                    at += 1
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [f.split()[0] for f in fields.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, fields)
    rare = words.filter(F.col("n") < HEAD_SHARE * sizes["n"])
    rows = rows.join(rare, "word", "left")
    count, spelled = F.coalesce("n", F.lit(0)) + 1, F.col("spelled")
    rare_row = spelled.isNotNull()
    found = rows.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(rare_row & F.col("n").isNotNull(), 1).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(rare_row, F.log10(count) - lost).otherwise(0)).alias("base_score"),
        F.sum(F.col("score") + F.when(rare_row, F.log10(ROOT * count / space + (1 - ROOT) * spelled)).otherwise(0)).alias("score"),
    )
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 7) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(sizes["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *learn(docs))


QUERIES = {"op9_suffix_tree_lm": op9}
SQL: dict[str, str] = {}
