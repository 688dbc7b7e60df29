"""Packing documents into fixed windows in a mixture of sources.

Each source is a queue: its documents' tokens one after another. A deficit round-robin serves the queues in slots of
256 tokens: each source's deficit grows with time at its target share; when it comes to a whole slot, the slot is served
and paid. A round is eight windows of eight slots; what a source is owed of a round it gets in equal parts, so every window of 2048
tokens is filled and holds the target proportions to within a slot, and what a round leaves of a deficit is carried
into the next. A queue that runs dry is out; the others go on at
their shares. What is left of each queue beyond
whole slots and windows forms the tail, packed end to end; only the very last window can be short.

A deficit follows from the time alone, so any task can compute where a slot of a queue goes without walking through
the windows before it: deficits carry over windows and partitions by construction, and the plan that tasks get
is a few numbers for each queue.

Jobs: (1) tokenise and write ids with each document's place in its part of its queue; (2) sum tokens by part
and source, and prefix sums over parts; (3) cut documents at the slots and emit pieces. The driver sees one
row per queue: sources with a target and the largest others, QUEUES in all, have one each, the rest share one. Texts are not shuffled.

Defined cases: a null or empty text is one token, the end id 1. Null and empty sources are one queue. Sources
without a target have share 0 and go to the tail. Repeated rows and null ids are packed like any other row.
An empty table gives an empty table.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Mapping, Sequence
from functools import cache
from math import gcd
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, slices, table

TOKENIZER, END_ID = "word_bpe_49k.json", 1
LENGTH, SLOT, ROUND, QUEUES = 2048, 256, 8, 2_000
MOST_TIME, GOLDEN, CACHE = float(1 << 50), (5**0.5 - 1) / 2, 800_000
#: Each byte of white space as a space; and A-Z lower-cased too.
SPACED = bytes(32 if 9 <= i <= 13 else i for i in range(256))
LOWERED = SPACED.lower()
#: Words that the tokenizer is given in one call.
RUN = 200
PUNCTUATION = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"


def _ends_in_letter(word: bytes) -> bool:
    """Of what the tokenizer sees, as it composes and lower-cases first: then some letters end in a mark, which goes with the punctuation that follows."""
    last = word[-1]
    return 97 <= last <= 122 or 65 <= last <= 90 or last > 127 and normalize("NFC", word.decode()).lower()[-1].isalpha()


class WordTokenizer:
    """Ids of whole texts through a cache of words.

    The tokenizer cuts at white space before anything else and lower-cases, so a text's ids are its words' ids
    one after another, and punctuation that follows a letter is a token sequence of its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), {b"": b""}
        # a special token, which the tokenizer cuts out before anything else, parts many words in one call
        apart = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized and t.content.startswith("<|")]
        self.apart = apart[0] if apart else None

    def _encode(self, texts: list[str]) -> list[array]:
        return [array("H", found.ids) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        alone = [w for w in words if self.apart is None or b"<|" in w]
        for word, ids in zip(alone, self._encode([w.decode() for w in alone]), strict=True):
            self.cache[word] = ids.tobytes()
        if len(alone) == len(words):
            return
        words = [w for w in words if b"<|" not in w] if alone else words
        apart, name = self.apart[0], self.apart[1].encode()
        runs = [words[i : i + RUN] for i in range(0, len(words), RUN)]
        for run, ids in zip(runs, self._encode([name.join(run).decode() for run in runs]), strict=True):
            ends = [*(2 * np.flatnonzero(np.frombuffer(ids, "H") == apart)).tolist(), 2 * len(ids)]
            ids, at = ids.tobytes(), 0
            for word, end in zip(run, ends, strict=True):
                self.cache[word] = ids[at:end]
                at = end + 2

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.cache) > CACHE:
            self.cache = {b"": b""}
        known, split, new = self.cache, {}, set()
        found = list(map(known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i in missing:
            base = words[i].rstrip(PUNCTUATION)
            if base and len(base) < len(words[i]) and b"<|" not in words[i] and _ends_in_letter(base):
                split[i] = base, words[i][len(base) :]
                new.update(split[i])
            else:
                new.add(words[i])
        if new := [w for w in new if w not in known]:
            self._learn(new)
        for i, (base, tail) in split.items():
            known[words[i]] = known[base] + known[tail]
        for i in missing:
            found[i] = known[words[i]]
        return found

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of each text. Python sees each distinct word of the texts once; Arrow cuts texts to words and puts ids together."""
        # special tokens match case and all
        spaced = [(t.translate(SPACED) if b"<|" in t else t.translate(LOWERED)) if t else b"" for t in texts]
        words = pc.split_pattern(pa.array(spaced, pa.large_binary()), b" ")
        coded = words.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        flat = pa.array(ids, pa.large_binary()).take(coded.indices)
        _, offsets, data = flat.buffers()
        if data is None:
            return [b""] * len(texts)
        ends, data = np.frombuffer(offsets, np.int64)[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist(), memoryview(data)
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


@cache
def shared_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, so that later tasks find its words."""
    return WordTokenizer(path)


def _tokenise(path: str):
    def run(batches):
        encode, end, at = shared_tokenizer(path), np.array([END_ID], "<u2").tobytes(), {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            for piece in slices(batch, 2, 4096):
                ids = [x + end for x in encode(piece.column(2).cast(pa.binary()).to_pylist())]
                sizes, starts = [len(x) // 2 for x in ids], []
                for source, n in zip(piece.column(1).to_pylist(), sizes, strict=True):
                    starts.append(at.get(source, 0))
                    at[source] = starts[-1] + n
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "part", "at", "n", "ids"])

    return run


class Plan:
    """Where the slots of each queue go. sizes: tokens of each queue; shares: its target share."""

    def __init__(self, sizes: Sequence[int], shares: Sequence[float], slot: int = SLOT, length: int = LENGTH, windows: int = ROUND):
        size, share = np.array(sizes, np.int64), np.maximum(np.array(shares, float), 0)
        self.slot, self.length, self.per, self.round = slot, length, length // slot, windows * (length // slot)
        self.slots = np.where(share > 0, size // slot, 0)
        rate = np.where(self.slots > 0, share, 0.0)
        self.rate = np.maximum(rate / max(rate.sum(), 1e-300), self.slots / MOST_TIME)
        # queues of equal shares aren't all owed a whole slot at the same time
        self.start = np.arange(len(size)) * GOLDEN % 1.0
        # when queues run dry, and how many slots are paid by then: between two such times they are paid evenly
        dry = np.sort(np.concatenate([[0.0], self.slots[self.rate > 0] / self.rate[self.rate > 0]]))
        order = np.argsort(self.slots[self.rate > 0] / self.rate[self.rate > 0], kind="stable")
        gone, left = np.cumsum(self.slots[self.rate > 0][order]), self.rate.sum() - np.cumsum(self.rate[self.rate > 0][order])
        self.dry, self.dry_paid = dry, np.concatenate([[0.0], np.maximum.accumulate(gone + np.maximum(left, 0) * dry[1:])])
        self.rounds = int(self.dry_paid[-1] // self.round) + 2
        self.slots = self.until(np.array([self.rounds]))[0]
        rest = size - self.slots * slot
        self.tail = self.slots.sum() * slot + np.cumsum(rest) - rest

    def due(self, k: np.ndarray, s: int | slice | np.ndarray = slice(None)) -> np.ndarray:
        """When the deficit of a queue comes to a whole slot for the time k, from 0."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (k + 1 - self.start[s]) / self.rate[s]

    def end(self, rounds: np.ndarray) -> np.ndarray:
        """When the first rounds end."""
        return np.where(rounds < self.rounds, np.interp(rounds * float(self.round), self.dry_paid, self.dry), np.inf)

    def until(self, rounds: np.ndarray) -> np.ndarray:
        """Slots of each queue (columns) in the first rounds: those that are due, up to a whole window."""
        time = np.minimum(self.end(rounds), 2 * self.dry[-1] + 1 / self.rate[self.rate > 0].min(initial=1.0))[:, None]
        n = np.floor(time * self.rate + self.start)
        for _ in range(2):  # rounding
            n -= self.due(n - 1) > time
            n += self.due(n) <= time
        n = np.clip(n, 0, self.slots).astype(np.int64)
        over = n.sum(axis=1) % self.per
        last = np.where(n > 0, self.due(n - 1), -1.0)
        for i in range(over.max(initial=0)):
            rows = np.flatnonzero(over > i)
            s = last[rows].argmax(axis=1)
            n[rows, s] -= 1
            last[rows, s] = np.where(n[rows, s] > 0, self.due(n[rows, s] - 1, s), -1.0)
        return n

    def place(self, s: int, k: np.ndarray) -> np.ndarray:
        """Slots among all windows of the slots k of queue s; k < slots[s]."""
        due, out, step = self.due(k, s), np.zeros(len(k), np.int64), max(1, (1 << 20) // len(self.slots))
        of = np.ceil(np.interp(due, self.dry, self.dry_paid) / self.round).astype(np.int64)
        of -= due <= self.end(of - 1)
        of += due > self.end(of)
        rows = np.arange(len(k))
        while len(rows):
            rounds, which = np.unique(of[rows], return_inverse=True)
            order = np.argsort(which, kind="stable")
            ends = np.searchsorted(which[order], np.arange(len(rounds) + 1))
            for i in range(0, len(rounds), step):
                old, new = self.until(rounds[i : i + step] - 1), self.until(rounds[i : i + step])
                first, windows = old.sum(axis=1), (new - old).sum(axis=1) // self.per
                base = (new - old) // np.maximum(windows, 1)[:, None]
                extra = new - old - base * windows[:, None]
                ahead, spare = base[:, :s].sum(axis=1), extra[:, :s].sum(axis=1)
                for j in range(len(old)):
                    own = rows[order[ends[i + j] : ends[i + j + 1]]]
                    of[own] += k[own] >= new[j, s]  # beyond the last whole window: in the next round
                    own = own[k[own] < new[j, s]]
                    if len(own):
                        out[own] = first[j] + self._spots(k[own] - old[j, s], int(windows[j]), int(base[j, s]), int(extra[j, s]), int(ahead[j]), int(spare[j]))
                        of[own] = -1
            rows = rows[of[rows] >= 0]
        return out

    def _spots(self, k: np.ndarray, windows: int, base: int, extra: int, ahead: int, spare: int) -> np.ndarray:
        """Places in a round of the slots k of a queue: base in each window and one more in `extra` windows, after those that went to the queues before it."""
        stride = max(1, int(windows * GOLDEN))
        while gcd(stride, windows) > 1:
            stride += 1
        n = np.full(windows, base)
        n[(spare + np.arange(extra)) % windows * stride % windows] += 1
        upto = np.cumsum(n)
        w = np.searchsorted(upto, k, "right")
        earlier = spare // windows + (w * pow(stride, -1, windows) % windows < spare % windows)
        return w * self.per + ahead + earlier + k - (upto - n)[w]

    def cut(self, s: int, a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """doc, start, length, place: the pieces of documents at a, of n tokens, in queue s."""
        k0, k1 = a // self.slot, (a + n - 1) // self.slot
        doc = np.repeat(np.arange(len(a)), k1 - k0 + 1)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(k1 - k0 + 1) - (k1 - k0 + 1), k1 - k0 + 1) + k0[doc]
        x0, x1 = np.maximum(a[doc], k * self.slot), np.minimum((a + n)[doc], (k + 1) * self.slot)
        g, late = self.tail[s] + x0 - self.slots[s] * self.slot, k >= self.slots[s]
        if not late.all():
            g[~late] = self.place(s, k[~late]) * self.slot + (x0 - k * self.slot)[~late]
        # pieces of the tail may cross into the next window
        over = np.minimum(x1 - x0, self.length - g % self.length)
        two = over < x1 - x0
        doc, g = np.repeat(doc, two + 1), np.repeat(g, two + 1)
        second = np.zeros(len(doc), bool)
        second[np.flatnonzero(two) + np.cumsum(two)[two]] = True
        x0, x1, over = np.repeat(x0, two + 1), np.repeat(x1, two + 1), np.repeat(over, two + 1)
        both = np.repeat(two, two + 1)
        start, stop = np.where(second, x0 + over, x0), np.where(both & ~second, x0 + over, x1)
        g = np.where(second, g + over, g)
        size = stop - start
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1] + size[:-1]) | (g[1:] // self.length != g[:-1] // self.length)
        first = np.flatnonzero(new)
        return doc[first], (start - a[doc])[first], np.add.reduceat(size, first) if len(first) else size, g[first]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _pieces(plan: Plan):
    def run(batches):
        for batch in batches:
            ids, doc_id, source = batch.column("ids"), batch.column("doc_id").to_pylist(), batch.column("source").to_pylist()
            a, n, s, out = batch.column("at").to_numpy(), batch.column("n").to_numpy(), batch.column("queue").to_numpy(), []
            for q in np.unique(s):
                rows = np.flatnonzero(s == q)
                doc, start, size, g = plan.cut(q, a[rows], n[rows])
                out.append((rows[doc], start, size, g))
            if not out:
                continue
            row, start, size, g = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((start, row))
            row, start, size, g = row[order], start[order], size[order], g[order]
            crc, last, wide = [], -1, b""
            for r, x, y in zip(row.tolist(), start.tolist(), size.tolist(), strict=True):
                if r != last:
                    last, wide = r, memoryview(np.frombuffer(ids[r].as_py(), "<u2").astype("<u4").tobytes())
                crc.append(zlib.crc32(wide[4 * x : 4 * (x + y)]))
            of = row.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc_id[r] for r in of], pa.int64()), *(pa.array(x, pa.int64()) for x in (start, size, crc, n[row], g // plan.length, g % plan.length)), pa.array([source[r] for r in of], pa.string())],
                [x.split()[0] for x in PIECES.split(", ")],
            )

    return run


def pack(docs: DataFrame, targets: Mapping[str, float] | None = None, tokenizer: str | None = None, temper: float = 1.0, queues: int = QUEUES) -> DataFrame:
    """One row per piece.

    targets: share of each source, by default its tokens to the power temper, so that below 1 rare sources come
    early and often; tokenizer: path of its file, of at most 65,536 ids; queues: sources with a queue of their own, but no fewer than there are targets.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    ids = materialize(rows.mapInArrow(_tokenise(tokenizer), "doc_id long, source string, part int, at long, n long, ids binary"), "ids")
    sums = materialize(ids.groupBy("source", "part").agg(F.sum("n").alias("n")), "parts")
    aimed = F.col("source").isin([k for k, v in targets.items() if v > 0]) if targets else F.lit(False)
    own = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(aimed.desc(), F.desc("n"), "source").limit(max(queues, len(targets or ()))).collect()
    names, tokens = [r[0] for r in own], [r[1] for r in own]
    rest = (sums.agg(F.sum("n")).first()[0] or 0) - sum(tokens)
    shares = [float(targets.get(x, 0.0)) for x in names] if targets else [float(x) ** temper for x in tokens]
    if rest:  # one queue for all other sources
        shares.append(0.0 if targets else float(rest) ** temper)
        tokens.append(rest)
    queue = F.broadcast(docs.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "source string, queue int"))
    sums = sums.join(queue, "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(names))))
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("part", "source")) - F.col("n")
    sums = materialize(sums.select("source", "part", "queue", before.alias("before")), "before")
    placed = ids.join(sums, ["source", "part"])
    placed = placed.select("doc_id", "source", "queue", (F.col("at") + F.col("before")).alias("at"), "n", "ids")
    return placed.mapInArrow(_pieces(Plan(tokens, shares)), PIECES)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op2_drr_packing": op2}
SQL: dict[str, str] = {}
