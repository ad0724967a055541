"""Vectorised views of text columns, shared by the operators of this subpackage.

Spark hands text to Python as Arrow batches.  ``blocks`` cuts a batch into runs of whole rows of about
``BLOCK_BYTES`` UTF-8 bytes, so that the numpy arrays made from a run stay small whatever the batch size is; one row is
never cut, so the memory a task needs grows with the longest single text only.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from scriptorium.functions.arrowtext import utf8

BLOCK_BYTES = 1 << 20

_Q = np.uint64(0xD6E8FEB86659FD93 | 1)
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D))
#: Words of at most so many bytes are hashed together, 8 bytes at a time; longer ones one by one.
LANE_BYTES = 64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of whole rows of about ``limit`` bytes."""
    raw, at = utf8(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    key = int(base)
    if key not in _powers or len(_powers[key][0]) < n:
        size = max(n + n // 4, 1 << 16)
        out = []
        for b in (key, pow(key, -1, 1 << 64)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[key] = (out[0], out[1])
    up, down = _powers[key]
    return up[:n], down[:n]


class Words:
    """The words of a block: ``start`` and ``end`` (bytes), ``first`` (index of each row's first word, and the total)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, is_word: np.ndarray):
        self.raw, n = raw, len(raw)
        inside = is_word[raw]
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = inside
        after = np.append(inside[1:], False) if n else inside
        cuts = at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        before = before[:n]
        before[cuts] = False
        after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, at)
        self.n = len(self.start)

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; the two seeds (0 and 1) give independent ones, 128 bits together.  Each 8 bytes
        are mixed into the state before the next, so that no arrangement of parts makes two words alike."""
        size = self.end - self.start
        out = mixed(size.astype(np.uint64) * _Q + _SEEDS[seed])
        if not self.n:
            return out
        eights = np.ndarray(len(self.raw) + 1, "<u8", np.concatenate([self.raw, np.zeros(8, np.uint8)]), strides=(1,))
        live = np.flatnonzero(size <= LANE_BYTES)
        for lo in range(0, LANE_BYTES, 8):
            live = live[size[live] > lo]
            if not len(live):
                break
            spare = np.maximum(lo + 8 - size[live], 0).astype(np.uint64) * np.uint64(8)
            out[live] = mixed(out[live] ^ (eights[self.start[live] + lo] << spare) * _SEEDS[seed])
        for i in np.flatnonzero(size > LANE_BYTES).tolist():
            out[i] = np.frombuffer(hashlib.blake2b(self.bytes_of(i), digest_size=16).digest(), np.uint64)[seed]
        return out

    def left(self) -> np.ndarray:
        """How many words of the same row begin at each word, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(self.n)

    def bytes_of(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()


class Grams:
    """Hashes of runs of consecutive words, from the words' hashes."""

    def __init__(self, words: np.ndarray):
        up, self.down = powers(_Q, max(1, len(words)))
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=self.total[1:])

    def of(self, n: int) -> np.ndarray:
        """The hash of the n words from each word on, as far as there are n words in the block."""
        size = max(0, len(self.total) - n)
        return mixed((self.total[n:] - self.total[:size]) * self.down[:size]) if size else np.zeros(0, np.uint64)

    def at(self, where: np.ndarray, n: int) -> np.ndarray:
        return mixed((self.total[where + n] - self.total[where]) * self.down[where]) if len(where) else np.zeros(0, np.uint64)


def found(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of x is among the sorted keys."""
    if not len(sorted_keys) or not len(x):
        return np.zeros(len(x), bool)
    i = np.searchsorted(sorted_keys, x)
    i[i == len(sorted_keys)] = 0
    return sorted_keys[i] == x


#: ASCII white space: space, and tab to carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False

#: ASCII digits and letters, and every byte of a code point above U+007F.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def packed(rows, schema: pa.Schema, size, limit: int = 4 << 20):
    """Record batches of about ``limit`` bytes from tuples in the schema's order; size(row) is a row's bytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row) + 64
        if total >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def each(column: pa.Array):
    """The Python values of a column, one at a time."""
    for x in column:
        yield x.as_py()


def typed(batches: Iterator[pa.RecordBatch], column: str) -> tuple[pa.DataType, Iterator[pa.RecordBatch]]:
    """The type of a column (null if there is no batch), and all the batches."""
    first = next(batches, None)
    return (pa.null(), iter(())) if first is None else (first.schema.field(column).type, itertools.chain([first], batches))
