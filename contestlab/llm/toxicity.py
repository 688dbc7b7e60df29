"""Toxicity scores from a convolutional text classifier.

A word is the sum of hashed embeddings: of the whole word and of its first 4 to 7 bytes. Convolutions of
widths 1, 2 and 3 run over the words of the whole text, max pooling takes each filter's largest answer,
and a logistic layer gives the logit. The network is trained in numpy with Adam.

Training takes every labelled row that isn't held out, whole texts of any length. Rows are split three ways by a hash of their id: the
first part gives each feature's smoothed log-odds, which start one embedding dimension, counted by Spark; the second trains the
network: pieces of about PIECE_ROWS rows are dealt to tasks, each trains the same starting network on its piece, and the weights of all pieces are averaged, by Spark too (an
embedding over the pieces that moved it); the third calibrates, by counts of logits. Thresholds are calibrated by language, as guessed from the text itself by word
counts (the LANGUAGES with most rows; others share one threshold); the logit is moved so that each language's threshold scores DECIDE. Scoring reads whole texts, in
chunks for very long ones, and takes nothing but the text.

Defined cases: null, empty and blank texts score what no words score. Labels that are null are left out; of
several labels for one id the largest counts. Without a positive or a negative label every score is the
base rate of the labels (0 without labels). Repeated rows score alike; an empty table gives an empty table.
"""

import copy
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, discard, free_name, materialize, slices, table

DECIDE, HELD_OUT = 0.3, 2
#: What one task trains on: enough rows for the network to settle, few enough to hold.
PIECE_ROWS, PIECE_BYTES = 3_000, 16_000_000
#: Calibration counts logits in steps of 1 / STEPS; languages beyond the most frequent ones share one threshold.
STEPS, LANGUAGES = 256, 200
BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 16, 12, 12, (1, 2, 3), (4, 5, 6, 7)
EPOCHS, BATCH, RATE, SEED = 5, 64, 0.01, 7
CHUNK_WORDS, CACHE = 200_000, 200_000
FEATURES = 1 + len(PREFIXES)
#: Letters: A-Z lower-cased and bytes beyond ASCII; all others become spaces.
LETTERS = bytes(c if 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def part_of(fold):
    """What a fold of 20 is for: 0 log-odds, 1 training, 2 calibration."""
    return 0 if fold < 9 else 1 if fold < 16 else 2


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTERS).split()


def features(word: bytes) -> list[int]:
    return [zlib.crc32(word) % BUCKETS, *(zlib.crc32(word[:n], n) % BUCKETS for n in PREFIXES)]


class Vocabulary(dict):
    """word -> row of its features; grows as words are met."""

    def __init__(self):
        self.flat = array("i", [BUCKETS] * FEATURES)  # row 0: padding

    def __missing__(self, word):
        self[word] = n = len(self) + 1
        self.flat.extend(features(word))
        return n

    def ids(self, start: int = 0) -> np.ndarray:
        """The features of all rows from start."""
        return np.array(self.flat, np.int32).reshape(-1, FEATURES)[start:]


def _stream(rows: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Word rows of all texts in one array, each followed by padding; and where each begins."""
    pad = [0] * max(WIDTHS)
    ids = np.fromiter(chain.from_iterable(chain(r, pad) for r in rows), np.int32)
    starts = np.cumsum([0, *(len(r) + len(pad) for r in rows[:-1])])
    return ids, starts.astype(np.int64)


def _groups(rows: list, sizes: Sequence[int]) -> Iterator[list]:
    """Neighbouring rows of fewer than CHUNK_WORDS words in all; a longer one alone."""
    k = 0
    while k < len(rows):
        stop, size = k + 1, sizes[k]
        while stop < len(rows) and size + sizes[stop] < CHUNK_WORDS:
            size += sizes[stop]
            stop += 1
        yield rows[k:stop]
        k = stop


def _pieces(group: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """_stream of a group of texts; of a very long text in chunks that overlap by the widest filter, padded at its end only."""
    if len(group) > 1 or len(group[0]) <= CHUNK_WORDS:
        yield _stream(group)
        return
    size = CHUNK_WORDS + max(WIDTHS) - 1
    for a in range(0, len(group[0]), CHUNK_WORDS):
        chunk = group[0][a : a + size]
        ids, starts = _stream([chunk])
        yield (ids[:size] if len(chunk) == size else ids), starts


class Network:
    def __init__(self, rng: np.random.Generator):
        self.emb = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
        self.emb[BUCKETS] = 0
        self.conv = [rng.normal(0, (1 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for c in self.conv:
            c[0, 0, :2] = 0.5  # some filters begin on the log-odds
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.out.reshape(len(WIDTHS), FILTERS)[:, :2] = 0.3
        self.base = np.zeros(1, np.float32)

    def pooled(self, words: np.ndarray, starts: np.ndarray, argmax: bool = False):
        """Largest answer of each filter in each text and in its padding, which every text has."""
        n, best, at = len(words), [], []
        for w, conv, bias in zip(WIDTHS, self.conv, self.bias, strict=True):
            answer = words[: n - w + 1] @ conv[0]
            for j in range(1, w):
                answer += words[j : n - w + 1 + j] @ conv[j]
            for j in range(1, w):  # windows that would reach into the next text
                answer[starts[1:] - j] = -np.inf
            top = np.maximum.reduceat(answer, starts, axis=0)
            if argmax:
                ends = np.append(starts[1:], len(answer))
                at.append(np.stack([answer[a:b].argmax(axis=0) + a for a, b in zip(starts, ends, strict=True)]))
            best.append(np.maximum(top + bias, 0))
        return (np.concatenate(best, axis=1), at) if argmax else np.concatenate(best, axis=1)

    def logits(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.pooled(words, starts) @ self.out + self.base[0]

    def chosen(self, feats: np.ndarray, rows: list[Sequence[int]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Hidden values of texts of any length, and for each width the words (text, filter, place) that pooling chose."""
        hidden, spots = [], []
        for group in _groups(rows, [len(r) for r in rows]):
            for k, (ids, starts) in enumerate(_pieces(group)):
                used, inverse = np.unique(ids, return_inverse=True)
                h, at = self.pooled(_vectors(self.emb, feats[used])[inverse], starts, argmax=True)
                own = [ids[a[:, :, None] + np.arange(w)] for w, a in zip(WIDTHS, at, strict=True)]
                if k:  # a further piece of a long text
                    more = (h > hidden[-1]).reshape(1, len(WIDTHS), FILTERS)
                    spots[-1] = [np.where(more[:, i, :, None], new, old) for i, (new, old) in enumerate(zip(own, spots[-1], strict=True))]
                    hidden[-1] = np.maximum(h, hidden[-1])
                else:
                    hidden.append(h)
                    spots.append(own)
        return np.concatenate(hidden), [np.concatenate(s) for s in zip(*spots, strict=True)]

    def flat(self) -> np.ndarray:
        """All weights but the embedding's, in rows as long as an embedding."""
        every = np.concatenate([p.ravel() for p in (*self.conv, *self.bias, self.out, self.base)])
        return np.append(every, np.zeros(-len(every) % DIM, np.float32)).reshape(-1, DIM)

    def put(self, flat: np.ndarray) -> None:
        k, every = 0, flat.astype(np.float32).ravel()
        for p in (*self.conv, *self.bias, self.out, self.base):
            p[...] = every[k : k + p.size].reshape(p.shape)
            k += p.size


def _vectors(emb: np.ndarray, ids) -> np.ndarray:
    return emb[np.asarray(ids)].sum(axis=1)


def _train(net: Network, feats: np.ndarray, rows: list[Sequence[int]], y: np.ndarray, rng: np.random.Generator) -> None:
    """Adam on the logistic loss; the embedding's gradient is non-zero for the words that max pooling chose."""
    params = [*net.conv, *net.bias, net.out, net.base]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    square, step = np.zeros(BUCKETS + 1, np.float32), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            hidden, spots = net.chosen(feats, [rows[i] for i in pick])
            error = (1 / (1 + np.exp(-(hidden @ net.out + net.base[0]))) - y[pick]) / len(pick)
            back = (error[:, None] * net.out) * (hidden > 0)
            grads_c, grads_b, moved, pushes = [], [], [], []
            for i, w in enumerate(WIDTHS):
                g, gc = back[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(net.conv[i])
                live = g != 0
                for j in range(w):
                    ids = spots[i][:, :, j]
                    gc[j] = np.einsum("nfe,nf->ef", _vectors(net.emb, feats[ids.ravel()]).reshape(*ids.shape, DIM), g)
                    moved.append(ids[live])
                    pushes.append((g[:, :, None] * net.conv[i][j].T[None])[live])
                grads_c.append(gc)
                grads_b.append(g.sum(axis=0))
            step += 1
            grads = [*grads_c, *grads_b, hidden.T @ error + 1e-4 * net.out, error.sum(keepdims=True)]
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            words, inverse = np.unique(np.concatenate(moved), return_inverse=True)
            push = np.zeros((len(words), DIM), np.float32)
            np.add.at(push, inverse, np.concatenate(pushes))
            own = feats[words].ravel()
            push = np.repeat(push, feats.shape[1], axis=0)[own != BUCKETS]
            own = own[own != BUCKETS]
            np.add.at(square, own, (push * push).sum(axis=1) / DIM)
            np.add.at(net.emb, own, -0.3 * RATE * push / (square[own, None] ** 0.5 + 1e-8))


def trained(start: Network, texts: Sequence[bytes | None], y: np.ndarray) -> Network:
    """A copy of the network, trained on one piece of the rows."""
    net, vocabulary = copy.deepcopy(start), Vocabulary()
    rows = [array("i", map(vocabulary.__getitem__, words_of(t))) for t in texts]
    _train(net, vocabulary.ids(), rows, y, np.random.default_rng(SEED))
    return net


class Counts:
    """of[class, None]: rows with each feature by class (0, 1); of[2, lang]: rows with each whole word by language."""

    def __init__(self):
        self.of, self.cache = {}, Vocabulary()

    def add(self, text: bytes | None, toxic: int, lang: str | None) -> None:
        if len(self.cache) > CACHE:
            self.cache = Vocabulary()
        words = [self.cache[w] for w in set(words_of(text))]
        feats = np.array([f for w in words for f in self.cache.flat[w * FEATURES : (w + 1) * FEATURES]], np.int64).reshape(-1, FEATURES)
        for key, own in (((int(toxic > 0), None), feats), *((((2, lang), feats[:, 0]),) if lang is not None else ())):
            if key not in self.of:
                self.of[key] = np.zeros(BUCKETS + 1)
            self.of[key][np.unique(own)] += 1


class Model:
    """A trained network with guessed-language thresholds. score() takes texts only."""

    def __init__(self, texts: Sequence[bytes | None] = (), toxic: Sequence[int] = (), langs: Sequence[str | None] = (), ids: Sequence[int] = ()):
        """Trained on rows at hand, by the steps that train() gives to tasks."""
        y, self.net = np.array(toxic, np.float32), None
        self.base_rate = float(y.mean()) if len(y) else 0.0
        if not 0 < self.base_rate < 1:
            return
        fold = np.array([part_of(zlib.crc32(f"fold{i}".encode()) % 20) for i in ids])
        if min(y[fold == part].sum() for part in range(3)) < 2:
            stats = fit = test = np.arange(len(y))
        else:
            stats, fit, test = (np.flatnonzero(fold == part) for part in range(3))
        counts = Counts()
        for i in stats:
            counts.add(texts[i], y[i], langs[i])
        self.begin(counts.of, float(y[stats].sum()), float((1 - y[stats]).sum()))
        self.net = trained(self.net, [texts[i] for i in fit], y[fit])
        logit, guess = self._raw([texts[i] for i in test])
        self.calibrate(guess, np.ones(len(test)), y[test], logit, logit)

    def begin(self, counts: dict, n1: float, n0: float) -> None:
        """The network before training, and the words of languages; counts: documents by feature, in n1 toxic and n0 other rows, and by whole word in each language."""
        none = np.zeros(BUCKETS + 1)
        pos, neg = counts.get((1, None), none), counts.get((0, None), none)
        n1, n0 = max(1.0, n1), max(1.0, n0)
        ratio = np.log((pos + 0.5 * n1 / n0) / n1) - np.log((neg + 0.5) / n0)
        odds = ratio * np.minimum(1, (pos + neg) / 8)
        odds[(pos + neg < 2) | (np.arange(BUCKETS + 1) == BUCKETS)] = 0
        self.langs = sorted(lang for _, lang in counts if lang is not None)
        by_lang = np.stack([counts[2, lang] for lang in self.langs], axis=1) + 0.1 if self.langs else np.zeros((BUCKETS + 1, 0))
        by_lang = np.log(by_lang / by_lang.sum(axis=0))
        by_lang -= by_lang.mean(axis=1, keepdims=True) if self.langs else 0
        by_lang[BUCKETS] = 0
        self.lang_table = by_lang.astype(np.float32)
        self.net = Network(np.random.default_rng(SEED))
        self.net.emb[:, 0] = (np.clip(odds, -2, 4) / 4).astype(np.float32)

    def calibrate(self, guess: np.ndarray, n: np.ndarray, hits: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Thresholds from n rows each, hits of them toxic, of a guessed language and logits from low to high."""
        self.shift = np.zeros(max(1, len(self.langs)), np.float32)
        self.shift += self._threshold(n, hits, low, high)
        for i in range(len(self.langs)):
            own = guess == i
            if hits[own].sum() >= 5:
                self.shift[i] = self._threshold(n[own], hits[own], low[own], high[own])
        for name in ("cache", "vectors", "votes"):  # each task fills its own
            self.__dict__.pop(name, None)

    @staticmethod
    def _threshold(n: np.ndarray, hits: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
        """The logit threshold of the best F1, in the middle of its gap."""
        order = np.argsort(-low, kind="stable")
        f1 = 2 * np.cumsum(hits[order]) / (np.cumsum(n[order]) + hits.sum())
        k = int(f1.argmax())
        below = high[order[k + 1]] if k + 1 < len(order) else low[order[k]] - 1
        return float((low[order[k]] + below) / 2)

    def _raw(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """logit, guessed language of each text."""
        if len(getattr(self, "cache", ())) > CACHE or not hasattr(self, "cache"):
            self.cache, self.vectors, self.votes = Vocabulary(), np.zeros((0, DIM), np.float32), np.zeros((0, len(self.langs)), np.float32)
        logit, guess = np.zeros(len(texts), np.float32), np.zeros(len(texts), np.int64)
        rows = [words_of(t) for t in texts]
        k = 0
        for group in _groups(rows, [len(r) for r in rows]):
            logit[k : k + len(group)], guess[k : k + len(group)] = self._some(group)
            k += len(group)
        return logit, guess

    def _some(self, rows: list[list[bytes]]):
        get = self.cache.__getitem__
        if len(rows) == 1 and len(rows[0]) > CHUNK_WORDS:
            row, pooled, votes = array("i", map(get, rows[0])), [], 0
            self._extend()
            for ids, starts in _pieces([row]):
                pooled.append(self.net.pooled(self.vectors[ids], starts))
                votes = votes + self.votes[ids[:CHUNK_WORDS]].sum(axis=0)
            return (np.max(pooled, axis=0) @ self.net.out + self.net.base[0]), (votes.argmax() if self.langs else 0)
        ids, starts = _stream([list(map(get, r)) for r in rows])
        self._extend()
        logit = self.net.logits(self.vectors[ids], starts)
        return logit, (np.add.reduceat(self.votes[ids], starts, axis=0).argmax(axis=1) if self.langs else np.zeros(len(rows), np.int64))

    def _extend(self) -> None:
        if len(self.cache) + 1 > len(self.vectors):
            new = self.cache.ids(len(self.vectors))
            self.vectors = np.concatenate([self.vectors, _vectors(self.net.emb, new)])
            self.votes = np.concatenate([self.votes, self.lang_table[new[:, 0]]])

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.base_rate)
        logit, guess = self._raw(texts)
        moved = logit.astype(np.float64) - self.shift[guess] + np.log(DECIDE / (1 - DECIDE))
        return 1 / (1 + np.exp(-np.clip(moved, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES, languages: int = LANGUAGES) -> Model:
    """A model from all labelled rows that aren't held out. The driver sees tables as large as the model only."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(crc_mod(F.col("id"), 4) != HELD_OUT)
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # both sides grow, so they are sorted at any size; held-out texts needn't travel
    own = own.filter(crc_mod(F.col("id"), 4) != HELD_OUT).join(known.hint("merge"), "id")
    fold = F.crc32(F.concat(F.lit("fold"), F.col("id").cast("string")).cast("binary")) % 20
    rows = materialize(own.withColumn("part", F.when(fold < 9, 0).when(fold < 16, 1).otherwise(2)), "labelled", keep=True)
    try:
        return _fitted(rows, piece_rows, piece_bytes, languages)
    finally:
        discard(rows)


def _fitted(rows: DataFrame, piece_rows: int, piece_bytes: int, languages: int) -> Model:
    sums = {r["part"]: r for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("octets")).collect()}
    model = Model()
    n, hits = (sum(r[x] for r in sums.values()) for x in ("n", "hits"))
    model.base_rate = hits / n if n else 0.0
    if not 0 < model.base_rate < 1:
        return model
    whole = len(sums) < 3 or min(r["hits"] for r in sums.values()) < 2
    stats, fit, test = (rows if whole else rows.filter(F.col("part") == part) for part in range(3))
    of = lambda part, x: sum(r[x] for p, r in sums.items() if whole or p == part)
    frequent = [r["lang"] for r in stats.filter("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    model.begin(_counted(stats, frequent), of(0, "hits"), of(0, "n") - of(0, "hits"))
    _average(model.net, fit, max(1, round(of(1, "n") / piece_rows), round(of(1, "octets") / piece_bytes)), piece_rows, piece_bytes)
    cuts = _logits(test, model).toPandas()
    model.calibrate(*(cuts[c].to_numpy(float) for c in ("guess", "n", "hits", "low", "high")))
    return model


def _counted(rows: DataFrame, langs: list[str]) -> dict:
    """Counts of all rows: each task counts its own, Spark adds them up by feature."""
    known = set(langs)

    def run(batches):
        counts = Counts()
        for batch in batches:
            for piece in slices(batch, 0):
                for text, toxic, lang in zip(piece.column(0).cast(pa.binary()).to_pylist(), piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
                    counts.add(text, toxic, lang if lang in known else None)
        for (kind, lang), of in counts.of.items():
            at = np.flatnonzero(of)
            yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(at), pa.int32()), "lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(of[at].astype(np.int64))})

    each = rows.select("text", "toxic", "lang").mapInArrow(run, "kind int, lang string, bucket int, n long").groupBy("kind", "lang", "bucket").agg(F.sum("n").alias("n"))
    found = {(2, lang): np.zeros(BUCKETS + 1) for lang in langs}
    for (kind, lang), own in each.toPandas().groupby(["kind", "lang"], dropna=False):
        of = found.setdefault((int(kind), lang if kind == 2 else None), np.zeros(BUCKETS + 1))
        of[own.bucket.to_numpy()] = own.n.to_numpy()
    return found


def _average(net: Network, rows: DataFrame, pieces: int, piece_rows: int, piece_bytes: int) -> None:
    """Trains net on all rows: each piece trains a copy, and what the copies moved is averaged by rows."""
    sent = rows.sparkSession.sparkContext.broadcast(net)
    columns = [f"d{i}" for i in range(DIM)]

    def step(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        piece = pa.Table.from_batches(held).sort_by([("id", "ascending"), ("text", "ascending")])
        start = sent.value
        done = trained(start, piece["text"].cast(pa.binary()).to_pylist(), piece["toxic"].to_numpy().astype(np.float32))
        at = np.flatnonzero((done.emb != start.emb).any(axis=1))
        moved = np.concatenate([done.emb[at] - start.emb[at], done.flat() - start.flat()]).astype(float) * len(piece)
        at = np.concatenate([at, BUCKETS + 1 + np.arange(len(moved) - len(at))])
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(at), len(piece)), pa.int64()), *(pa.array(moved[:, i]) for i in range(DIM))], ["at", "n", *columns])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, octets = [], 0, 0
        for batch in batches:
            for piece in slices(batch, batch.schema.get_field_index("text")):
                held.append(piece)
                count, octets = count + piece.num_rows, octets + piece.nbytes
                if count >= 2 * piece_rows or octets >= 2 * piece_bytes:  # rows of one id, say: more than were dealt for
                    yield step(held)
                    held, count, octets = [], 0, 0
        if held:
            yield step(held)

    dealt = rows.select(F.pmod(F.xxhash64("id", F.lit("piece")), F.lit(pieces)).alias("piece"), "id", "text", "toxic")
    moved = dealt.groupBy("piece").applyInArrow(fit, f"at int, n long, {', '.join(f'{c} double' for c in columns)}")
    found = moved.groupBy("at").agg(*((F.sum(c) / F.sum("n")).alias(c) for c in columns)).toPandas()
    at, mean = found["at"].to_numpy(), found[columns].to_numpy()
    flat = net.flat()
    flat[at[at > BUCKETS] - BUCKETS - 1] += mean[at > BUCKETS].astype(np.float32)
    net.emb[at[at <= BUCKETS]] += mean[at <= BUCKETS].astype(np.float32)
    net.put(flat)
    sent.unpersist()


def _logits(rows: DataFrame, model: Model) -> DataFrame:
    """How many rows, and toxic ones, have about the same logit, by guessed language."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = sent.value
        for batch in batches:
            for piece in slices(batch, 0):
                logit, guess = net._raw(piece.column(0).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(guess, pa.int32()), pa.array(logit.astype(float)), piece.column(1)], ["guess", "logit", "toxic"])

    each = rows.select("text", "toxic").mapInArrow(run, "guess int, logit double, toxic int")
    about = F.floor(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("logit"))) * STEPS)
    return each.groupBy("guess", about.alias("about")).agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"), F.min("logit").alias("low"), F.max("logit").alias("high")).orderBy("guess", "about")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = sent.value
        for batch in batches:
            for piece in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(net.score(piece.column(1).cast(pa.binary()).to_pylist()), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    held = crc_mod(F.col("doc_id"), 4) == HELD_OUT
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= DECIDE).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score under DECIDE, with all their columns."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), free_name(docs, "tox_score")

    @F.pandas_udf("double")
    def text_score(text: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([sent.value.score([None if t is None else t.encode() for t in text[i : i + 256]]) for i in range(0, len(text), 256)] or [np.zeros(0)]))

    return docs.withColumn(name, text_score(F.col("text").cast("string"))).filter(F.col(name) < DECIDE).select(*docs.columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op3_toxicity_cnn": op3}
SQL: dict[str, str] = {}
