"""Byte n-grams as numbers: codes of texts, a hash table in numpy, and scores through context trees.

A gram of order k is k bytes of context and one symbol, in a uint64 with the symbol in the lowest byte.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

PAD = 0x0A
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << (8 * n_bytes)) - 1)


def codes_of(texts: list[bytes], order: int, before: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all symbols of all texts, and how many of each text. before: the `order` bytes before each text, by default padding."""
    before = before or [bytes([PAD]) * order] * len(texts)
    stream = np.frombuffer(b"".join(chain.from_iterable(zip(before, texts, strict=True))), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.zeros(max(0, len(stream) - order), np.uint64)
    for j in range(order, -1, -1):
        code <<= np.uint64(8)
        code |= stream[order - j : len(stream) - j] if len(code) else code
    if len(texts) > 1:
        # drop the grams whose symbol is padding of the texts after the first
        keep = np.ones(len(code), bool)
        starts = np.cumsum(sizes + order)[:-1] - order
        keep[(starts[:, None] + np.arange(order)).ravel()] = False
        code = code[keep]
    return code, sizes


def pieces(texts: list[bytes], order: int, limit: int):
    """(first text, codes, sizes) for runs of texts of about `limit` bytes; a longer text comes in several pieces of one text each."""
    k = 0
    while k < len(texts):
        if len(texts[k]) > limit:
            code, _ = codes_of([texts[k][:limit]], order)
            yield k, code, np.array([len(code)])
            for a in range(limit, len(texts[k]), limit):
                code, _ = codes_of([texts[k][a - order : a + limit]], order)
                yield k, code[order:], np.array([len(code) - order])
            k += 1
            continue
        stop, size = k + 1, len(texts[k])
        while stop < len(texts) and size + len(texts[stop]) <= limit:
            size += len(texts[stop])
            stop += 1
        yield (k, *codes_of(texts[k:stop], order))
        k = stop


def sums_by_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the rows of values for each text; texts may be empty."""
    out = np.zeros((len(sizes), *values.shape[1:]))
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full], axis=0, dtype=np.float64)
    return out


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts (keys, counts) and their counts summed."""
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)


class Table:
    """find(codes): the row of each code among the distinct keys, or -1. Open addressing, no Python loop over rows."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.rows, self.keys = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.uint64)
        rows, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(rows):
            free = self.rows[at] < 0
            self.rows[at[free]] = rows[free]
            self.keys[at] = np.where(self.rows[at] == rows, keys[rows], self.keys[at])
            lost = self.rows[at] != rows
            rows, at = rows[lost], (at[lost] + 1) & self.last
        used = self.rows >= 0
        self.keys[used] = keys[self.rows[used]]

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        at = self._home(codes)
        found = self.rows[at]
        open_ = np.flatnonzero((found >= 0) & (self.keys[at] != codes))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.last
            row = self.rows[at]
            found[open_] = row
            more = (row >= 0) & (self.keys[at] != codes[open_])
            open_, at = open_[more], at[more]
        return found


class ContextTree:
    """Values of symbols in contexts of variable length, for several models at once.

    grams[k], values[k]: order-k grams and their values, each already through all escapes; contexts[k],
    escapes[k]: contexts of k bytes and what a symbol that isn't among their grams adds; floor: the value of
    a symbol that no order has.
    """

    def __init__(self, grams, values, contexts, escapes, floor: float):
        self.order, self.floor = len(grams) - 1, floor
        self.grams, self.values = [Table(g) for g in grams], [np.ascontiguousarray(v, np.float32) for v in values]
        self.contexts, self.escapes = [Table(c) for c in contexts], [np.ascontiguousarray(e, np.float32) for e in escapes]

    def score(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.values[0].shape[1]), np.float32)
        left = None
        for k in range(self.order, -1, -1):
            row = self.grams[k].find(codes & mask(k + 1))
            if left is None:
                out[:] = self.values[k][row] if len(self.values[k]) else 0
                missed = np.flatnonzero(row < 0)
                out[missed], left = 0, missed
            else:
                hit = row >= 0
                out[left[hit]] += self.values[k][row[hit]]
                missed = np.flatnonzero(~hit)
                left = left[missed]
            codes = codes[missed]
            if not len(left):
                return out
            row = self.contexts[k].find((codes >> np.uint64(8)) & mask(k))
            hit = row >= 0
            out[left[hit]] += self.escapes[k][row[hit]]
        out[left] += self.floor
        return out
