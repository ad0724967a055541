"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The vocabulary comes from a model file whose path is a parameter; its pieces are only read, never trained.  Its scores are
merge ranks, not probabilities, so a piece of rank r weighs 1 / (Z (r + 1)) to the power ``theta``, as Zipf's law would have
it.  A segmentation of a text is as likely as the product of its pieces' weights.

Forward filtering adds up, for every place in the text, the weights of all paths that lead there; backward sampling then
walks from the end and draws the last piece among those that end where it stands, each as likely as the paths through it.
The draws are hashes of (row key, place, seed), so a row's segmentation depends on nothing else: not on partitions, order or
retries.  No piece crosses from a word into the next space, so the lattice falls apart into words there, and equal words of
a block share their forward pass; it also falls apart wherever else no piece crosses, as between most Chinese characters.
That changes no probability.  ``best`` takes the likeliest segmentation instead.  Draws have 24 bits, so a piece that is the
last one with a probability below 6e-8 isn't drawn.

A text of more than ``BLOCK`` bytes is taken in parts of about ``PART`` characters that end where the lattice falls apart.
Where it nowhere does, the forward pass keeps its state at the beginning of each part only, and the backward pass makes one
part's lattice after the other again.  So memory doesn't grow with the text beyond some 20 bytes for each of its characters.

A space is the piece character U+2581, and one more is put before a text that isn't empty.  A character that no piece of one
character covers, and a literal U+2581, is encoded as its UTF-8 bytes' pieces.  Decoding takes the bytes of all pieces and
drops the first space: it gives back every text exactly.  Null and empty texts have no pieces; a key that isn't a whole number
draws as a hash of it, and a null key as key 0; rows with equal keys and texts get equal pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from scriptorium.llm.shared import fresh, with_fields
from scriptorium.llm.textblock import blocks, mixed, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THETA, SEED = 1.0, 1
SPACE, LITERAL = 0x2581, 0x110000
#: Parts of the lattice of at most so many characters go through numpy together; longer ones one place at a time.
SHORT = 48
#: A factor for each character, the same for all paths through a word; it keeps sums of paths near 1.
SCALE = 30.0
BLOCK, PART = 1 << 20, 1 << 18
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Slots of the tables by which pieces are looked up, as a power of two.
_SLOTS = 17


@dataclass
class Vocabulary:
    """Pieces by length in characters: hashes with ids and weights, and where to look a hash up; byte pieces, and the bytes of
    every id."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]
    byte_id: np.ndarray
    unknown: float
    raw: np.ndarray
    offset: np.ndarray


@lru_cache(4)
def load(path: str = MODEL, theta: float = THETA) -> Vocabulary:
    """Read a vocabulary in the driver."""
    import sentencepiece

    with open(path, "rb") as f:
        model = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    n = model.get_piece_size()
    byte_id, text, by = np.full(256, -1, np.int32), [b""] * n, {}
    total = np.log(n)
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_id[int(piece[3:-1], 16)] = i
            text[i] = bytes((int(piece[3:-1], 16),))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            points = np.array([ord(c) for c in piece], np.uint64)
            rank = min(max(-model.get_score(i), 0.0), n)
            by.setdefault(len(points), []).append((_hash(points), i, float((1 / (total * (rank + 1))) ** theta)))
            text[i] = piece.replace("▁", " ").encode()
    if (byte_id < 0).any():
        raise ValueError("the model has no piece for some byte: not every text could be encoded")
    lengths = {}
    for size, found in by.items():
        found.sort()
        keys = np.array([x[0] for x in found], np.uint64)
        lengths[size] = (keys, np.array([x[1] for x in found], np.int32), np.array([x[2] for x in found]) * SCALE**size, _index(keys))
    least = min((x[2] / SCALE**size).min() for size, x in lengths.items())
    return Vocabulary(lengths, byte_id, least * 1e-4 * SCALE, np.frombuffer(b"".join(text), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in text])]))


def _hash(points: np.ndarray) -> int:
    up, _ = powers(_BASE, len(points))
    return int(((points + np.uint64(1)) * up).sum(dtype=np.uint64))


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h * _STEP) >> np.uint64(64 - _SLOTS)).astype(np.int64)


def _index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each slot the place of its key, negative (and less by one) if it has more keys; those others, sorted, and their places."""
    slot = _slot(keys)
    table = np.zeros(1 << _SLOTS, np.int32)
    _, first, count = np.unique(slot, return_index=True, return_counts=True)
    table[slot[first]] = np.where(count > 1, -first - 1, first)
    others = np.setdiff1d(np.arange(len(keys)), first)
    others = others[np.argsort(keys[others])]
    return table, keys[others], others


def _look_up(h: np.ndarray, keys: np.ndarray, index: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(which of the hashes are among the keys, and where)."""
    table, others, places = index
    at = table[_slot(h)]
    more = at < 0
    at = np.where(more, -at - 1, at)
    same = keys[at] == h
    rest = np.flatnonzero(more & ~same)
    if len(rest):
        k = np.minimum(np.searchsorted(others, h[rest]), len(others) - 1)
        hit = others[k] == h[rest]
        at[rest[hit]], same[rest[hit]] = places[k[hit]], True
    which = np.flatnonzero(same)
    return which, at[which]


def _hits(v: Vocabulary, points: np.ndarray, inside: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, places, ids, weights) of the pieces that end at a place; inside: how many characters up to there they may have."""
    n = len(points)
    up, down = powers(_BASE, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    hits, at = [], np.arange(n)
    for size, (keys, ids, weights, index) in sorted(v.by_length.items()):
        at = at[inside[at] >= size] if size > 1 else at
        which, k = _look_up((total[at + 1] - total[at + 1 - size]) * down[at + 1 - size], keys, index)
        if len(which):
            hits.append((size, at[which], ids[k], weights[k]))
    return hits


def _whole(hits: list, n: int) -> np.ndarray:
    """The places before which no piece crosses, 0 among them."""
    crossing = np.zeros(n + 2, np.int64)
    for size, at, _, _ in hits:
        if size > 1:
            crossing += np.bincount(at - size + 2, minlength=n + 2) - np.bincount(at + 1, minlength=n + 2)
    return np.flatnonzero(np.cumsum(crossing[:n]) == 0)


class Chain:
    """The pieces that end at each of a run of places, by place and length, and the forward sums one place at a time."""

    def __init__(self, v: Vocabulary, hits: list, lo: int, hi: int):
        """hits: as of ``_hits``; a character that is no piece is one of id -1."""
        size, at, ids, weight = (np.concatenate([np.full(len(h[1]), h[0]) if i == 0 else h[i] for h in hits] or [np.zeros(0, np.int64)]) for i in range(4))
        own = (at >= lo) & (at < hi)
        size, at, ids, weight = size[own], at[own] - lo, ids[own], weight[own]
        bare = np.ones(hi - lo, bool)
        bare[at[size == 1]] = False
        bare = np.flatnonzero(bare)
        size, at, ids, weight = (np.concatenate(x) for x in ((size, np.ones(len(bare), np.int64)), (at, bare), (ids, np.full(len(bare), -1)), (weight, np.full(len(bare), v.unknown))))
        order = np.lexsort((size, at))
        self.size, self.at, self.ids, self.weight = size[order], at[order], ids[order].astype(np.int32), weight[order]
        self.first = np.searchsorted(self.at, np.arange(hi - lo + 1))

    def forward(self, state: list[float], best: bool) -> list[float]:
        """Sets ``term``, the weight of all paths through each piece, and ``sum`` for each place, in a scale of the place's
        own; state: the sums of the places before, the last one last.  Returns the state behind."""
        ahead, most = list(state), len(state)
        term, sums = [0.0] * len(self.at), [0.0] * (len(self.first) - 1)
        size, weight, first = self.size.tolist(), self.weight.tolist(), self.first.tolist()
        for p in range(len(sums)):
            now = 0.0
            for i in range(first[p], first[p + 1]):
                x = weight[i] * ahead[-size[i]]
                term[i] = x
                if not best:
                    now += x
                elif x > now:
                    now = x
            sums[p] = now
            ahead.append(now)
            if not 1e-100 < now < 1e100:
                ahead[-most:] = [x / now for x in ahead[-most:]]
        self.term, self.sum = term, sums
        return ahead[-most:]

    def back(self, p: int, draw: list[float], best: bool) -> tuple[list[int], list[int], int]:
        """From place p back to the first: (ids, the places at which pieces end, last first) and how far the last piece reaches
        beyond; draw: a number from 0 to 1 for each place at which a piece may end."""
        first, size, number, term, ids, places = self.first.tolist(), self.size.tolist(), self.ids.tolist(), self.term, [], []
        while p > 0:
            a, b = first[p - 1], first[p]
            if best:
                i = max(range(a, b), key=term.__getitem__)
            else:
                rest, i = draw[p - 1] * self.sum[p - 1], a
                while i < b - 1 and rest >= term[i]:
                    rest -= term[i]
                    i += 1
            ids.append(number[i])
            places.append(p - 1)
            p -= size[i]
        return ids, places, -p


class Lattice:
    """For every place in the words: the pieces that end there, by length, and how likely each is the last one drawn."""

    def __init__(self, v: Vocabulary, points: np.ndarray, start: np.ndarray, end: np.ndarray, best: bool):
        n = len(points)
        hits = _hits(v, points, np.arange(n) - np.repeat(start, end - start) + 1)
        self.most = max([1, *(h[0] for h in hits)])
        self.id, self.share = np.full((n, self.most), -1, np.int32), np.zeros((n, self.most), np.float32)
        for size, at, ids, weights in hits:
            self.id[at, size - 1] = ids
            self.share[at, size - 1] = weights
        self.share[self.id[:, 0] < 0, 0] = v.unknown
        # a place's weights are read once, to be replaced by its shares
        self.start = start = _whole(hits, n)
        self.end = end = np.append(start[1:], n)
        length, ahead = end - start, np.ones(n)
        self.chains: dict[int, Chain] = {}  # of the parts that are longer than SHORT
        order = np.argsort(-np.where(length > SHORT, 0, length), kind="stable")
        sorted_ = -np.where(length > SHORT, 0, length)[order]
        for j in range(1, min(SHORT, int(length.max(initial=0))) + 1):
            live = int(np.searchsorted(sorted_, -j, "right"))
            self._fill(ahead, start[order[:live]] + j - 1, j, best)
        for k in np.flatnonzero(length > SHORT).tolist():
            near = [(size, *(x[slice(*np.searchsorted(at, (start[k], end[k])))] for x in (at, ids, weights))) for size, at, ids, weights in hits]
            self.chains[k] = Chain(v, near, int(start[k]), int(end[k]))
            self.chains[k].forward([0.0] * (self.most - 1) + [1.0], best)

    def _fill(self, ahead: np.ndarray, at: np.ndarray, j: int, best: bool) -> None:
        """Place j of every word that has one: the sums of paths go into ``ahead``."""
        k = min(j, self.most)
        terms = self.share[at, :k].astype(np.float64)
        for i in range(1, min(j - 1, k) + 1):
            terms[:, i - 1] *= ahead[at - i]
        if best:
            ahead[at] = terms.max(axis=1)
            terms /= ahead[at][:, None]
        else:
            for i in range(1, k):
                terms[:, i] += terms[:, i - 1]
            ahead[at] = terms[:, -1]
            terms /= terms[:, -1:]
        self.share[at, :k] = terms
        if not best:
            self.share[at, k:] = 1


def _random(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers from 0 to a little below 1, so that they stay below the last share, 1, whatever the rounding."""
    return (mixed(key + place.astype(np.uint64) * _STEP) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24 * 0.999999)


def _points(raw: np.ndarray) -> np.ndarray:
    """The characters of a text; a space is the piece character, and that itself is told apart."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points == SPACE, np.uint32(LITERAL), np.where(points == 32, np.uint32(SPACE), points))


def encode_block(v: Vocabulary, raw: np.ndarray, at: np.ndarray, key: np.ndarray, best: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the rows of a block; key: uint64 for each row."""
    n = len(at) - 1
    starts_char = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]  # rows' offsets in characters
    size = np.diff(starts_char)
    full = size > 0
    points = np.insert(_points(raw), starts_char[:-1][full], np.uint32(SPACE))
    row_at = np.concatenate([[0], np.cumsum(size + full)])
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    ids, per_row = _spelt(v, *_drawn(v, points, row_at, key, 0, best))
    return ids, np.concatenate([[0], np.cumsum(per_row)])


def _drawn(v: Vocabulary, points: np.ndarray, row_at: np.ndarray, key: np.ndarray, before: int, best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of rows' pieces, -1 for a character that is none, the last character of each piece, and how many pieces each
    row has; before: how many characters a row has before these."""
    n, full = len(row_at) - 1, np.diff(row_at) > 0
    space = points == SPACE
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[row_at[:-1][full]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(points))
    row = np.searchsorted(row_at, start, "right") - 1
    # equal words share a lattice
    up, down = powers(_BASE, len(points))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    name = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)
    _, first, word = np.unique(name, return_index=True, return_inverse=True)
    length = end - start
    spread = lambda s, k: np.repeat(s - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
    if not np.array_equal(length, length[first][word]) or not np.array_equal(points, points[spread(start[first][word], length)]):
        first, word = np.arange(len(start)), np.arange(len(start))  # two words with one hash
    own = points[spread(start[first], length[first])]
    own_end = np.cumsum(length[first])
    lattice = Lattice(v, own, own_end - length[first], own_end, best)
    # backward, all parts of all words at once
    own_start = own_end - length[first]
    edge = np.searchsorted(lattice.start, np.append(own_start, len(own)))
    parts = np.diff(edge)[word]
    part, of = spread(edge[word], parts), np.repeat(np.arange(len(start)), parts)
    left = (lattice.end - lattice.start)[part]
    stand, place, seed = lattice.end[part] - 1, (start - row_at[row] - own_start[word])[of] + lattice.end[part] + before, key[row][of]
    count, steps, chained = np.zeros(len(part), np.int64), [], []
    for u in np.flatnonzero(left > SHORT).tolist():
        size = int(left[u])
        found, places, _ = lattice.chains[int(part[u])].back(size, _random(np.repeat(seed[u : u + 1], size), np.arange(place[u] - size + 1, place[u] + 1)).tolist(), best)
        chained.append((u, found, own[lattice.start[part[u]] + np.array(places)]))
        count[u] = len(found)
    who = np.flatnonzero(left <= SHORT)
    left, stand, place, seed = left[who], stand[who], place[who], seed[who]
    while len(who):
        if best:
            size = lattice.share[stand].argmax(axis=1) + 1
        else:
            share = lattice.share[stand]
            size = np.minimum(np.count_nonzero(share <= _random(seed, place)[:, None], axis=1) + 1, left)
        steps.append((who, lattice.id[stand, size - 1], own[stand]))
        count[who] += 1
        left, stand, place = left - size, stand - size, place - size
        more = left > 0
        who, left, stand, place, seed = who[more], left[more], stand[more], place[more], seed[more]
    stop = np.cumsum(count)
    ids, point = np.empty(stop[-1], np.int32), np.empty(stop[-1], np.uint32)
    for t, (w, i, c) in enumerate(steps):
        ids[stop[w] - 1 - t] = i
        point[stop[w] - 1 - t] = c
    for u, found, c in chained:
        ids[stop[u] - count[u] : stop[u]], point[stop[u] - count[u] : stop[u]] = found[::-1], c[::-1]
    row, count = row[of], count.astype(float)
    return ids, point, np.bincount(row, weights=count, minlength=n).astype(np.int64)


def _spelt(v: Vocabulary, ids: np.ndarray, point: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with the pieces of their bytes in place of characters that are none."""
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids, per_row
    spelt = [(chr(SPACE) if c == LITERAL else chr(c)).encode("utf-8", "surrogatepass") for c in point[bare].tolist()]
    times = np.ones(len(ids), np.int64)
    times[bare] = [len(b) for b in spelt]
    owner = np.repeat(np.arange(len(per_row)), per_row)
    wide = np.repeat(ids, times)
    wide[np.flatnonzero(wide < 0)] = v.byte_id[np.frombuffer(b"".join(spelt), np.uint8)]
    return wide, np.bincount(owner, weights=times, minlength=len(per_row)).astype(np.int64)


def encode_long(v: Vocabulary, raw: np.ndarray, key: np.uint64, best: bool = False, part: int = PART) -> np.ndarray:
    """The ids of one text, made part by part."""
    points = np.concatenate([[np.uint32(SPACE)], _points(raw)]) if len(raw) else np.zeros(0, np.uint32)
    keys, most, out, lo = np.array([key], np.uint64), max(v.by_length), [], 0

    def uncrossed(lo: int, hi: int, back: int) -> np.ndarray:
        """The places after lo, up to hi, that no piece crosses; one may begin ``back`` characters before lo at most."""
        near = points[lo - back : hi + most]
        whole = _whole(_hits(v, near, np.arange(len(near)) + 1), len(near)) + lo - back
        return whole[(whole > lo) & (whole <= hi)]

    while lo < len(points):
        hi = lo + part
        if hi >= len(points):
            hi = len(points)
        else:
            near = points[lo : hi + 1] == SPACE
            cuts = np.flatnonzero(near[1:] & ~near[:-1]) + lo + 1
            cuts = cuts if len(cuts) else uncrossed(lo, hi, 0)
            if not len(cuts):  # one lattice over several parts
                edges = [lo]
                while hi < len(points) and not len(cuts):
                    edges.append(hi)
                    cuts = uncrossed(hi, min(hi + part, len(points)), min(most, hi - lo))
                    hi = min(hi + part, len(points))
                hi = int(cuts[0]) if len(cuts) else len(points)
                out.append(_spelt(v, *_chained(v, points, [*edges, hi], keys, best))[0])
                lo = hi
                continue
            hi = int(cuts[-1])
        out.append(_spelt(v, *_drawn(v, points[lo:hi], np.array([0, hi - lo]), keys, lo, best))[0])
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _chained(v: Vocabulary, points: np.ndarray, edges: list[int], key: np.ndarray, best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_drawn``, of one lattice in parts between the edges."""
    most = max(v.by_length)

    def chain(lo: int, hi: int) -> Chain:
        back = min(most, lo - edges[0])
        near = points[lo - back : hi]
        return Chain(v, _hits(v, near, np.arange(len(near)) + 1), back, len(near))

    states = [[0.0] * (most - 1) + [1.0]]
    for lo, hi in zip(edges[:-2], edges[1:-1], strict=True):
        states.append(chain(lo, hi).forward(states[-1], best))
    ids, point, beyond = [], [], 0
    for lo, hi, state in zip(edges[-2::-1], edges[:0:-1], states[::-1], strict=True):
        if hi - lo <= beyond:
            beyond -= hi - lo
            continue
        own = chain(lo, hi)
        own.forward(state, best)
        found, places, beyond = own.back(hi - lo - beyond, _random(np.repeat(key, hi - lo), np.arange(lo + 1, hi + 1)).tolist(), best)
        ids += found
        point += points[lo + np.array(places)].tolist()
    return np.array(ids[::-1], np.int32), np.array(point[::-1], np.uint32), np.array([len(ids)])


def _bytes(v: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of pieces, and where each begins (and the total)."""
    size = np.diff(v.offset)[ids]
    stop = np.concatenate([[0], np.cumsum(size)])
    return v.raw[np.repeat(v.offset[ids] - stop[:-1], size) + np.arange(stop[-1])], stop


def decode_block(v: Vocabulary, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of rows of ids."""
    raw, stop = _bytes(v, ids)
    rows = stop[at]
    keep = np.ones(len(raw), bool)
    keep[rows[:-1][np.diff(at) > 0]] = False  # the space before the text
    return raw[keep], np.concatenate([[0], np.cumsum(keep)])[rows]


def decode_long(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of one row of ids, made part by part."""
    return b"".join(_bytes(v, ids[lo : lo + PART])[0].tobytes() for lo in range(0, len(ids), PART))[1:]


def _keys(column: pa.Array, seed: int) -> np.ndarray:
    return mixed(pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(seed) * _STEP)


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))


def encode(docs: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, theta: float = THETA, seed: int = SEED, best: bool = False, keep: bool = False) -> DataFrame:
    """doc_id, ``ids`` and ``lossless`` (whether decoding them gave the text back) of every row; with ``keep`` the row's
    own columns in place of doc_id, and then columns of these two names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path, theta))
    whole = isinstance(docs.select(F.col(key_col)).schema[0].dataType, T.IntegralType)
    number = F.col(key_col).cast("long") if whole else F.when(F.col(key_col).isNotNull(), F.xxhash64(F.col(key_col)))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "lossless")] if keep else [F.col(key_col).alias("doc_id")]
    kept = docs.select(*own)
    key, text = fresh([*docs.columns, "doc_id"], "key", "piece_text")
    rows = docs.select(*own, number.alias(key), F.col(text_col).alias(text))
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            keys = _keys(b.column(key), seed)
            for lo, hi, raw, at in blocks(b.column(text), BLOCK):
                if hi == lo + 1 and len(raw) > BLOCK:
                    ids = encode_long(v, raw, keys[lo], best)
                    offsets, each = np.array([0, len(ids)]), np.array([decode_long(v, ids) == raw.tobytes()])
                else:
                    ids, offsets = encode_block(v, raw, at, keys[lo:hi], best)
                    back, back_at = decode_block(v, ids, offsets)
                    same = np.array_equal(back, raw) and np.array_equal(back_at, at)
                    each = np.ones(hi - lo, bool) if same else np.array([back[back_at[i] : back_at[i + 1]].tobytes() == raw[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)])
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), _lists(ids, offsets), pa.array(each)], [*names, "ids", "lossless"])

    return rows.mapInArrow(run, with_fields(kept, names, "ids array<int>, lossless boolean"))


def decode(rows: DataFrame, *, key_col: str = "doc_id", ids_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """key and text of rows of ids; a null list is a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model_path))
    rows = rows.select(F.col(key_col).alias("key"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            size = pc.fill_null(b.column("ids").value_lengths(), 0).to_numpy(zero_copy_only=False)
            stop, lo = np.cumsum(size), 0
            while lo < b.num_rows:  # runs of rows of about PART pieces
                hi = max(lo + 1, int(np.searchsorted(stop, stop[lo] - size[lo] + PART, "right")))
                lists = b.column("ids").slice(lo, hi - lo)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if hi == lo + 1:
                    texts = [decode_long(v, ids).decode("utf-8", "surrogatepass")]
                else:
                    raw, at = decode_block(v, ids, np.concatenate([[0], np.cumsum(size[lo:hi])]))
                    texts = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)).to_pylist()
                text = pa.array([None if x is None else t for x, t in zip(lists, texts, strict=True)] if lists.null_count else texts, pa.string())
                yield pa.RecordBatch.from_arrays([b.column("key").slice(lo, hi - lo), text], ["key", "text"])
                lo = hi

    return rows.mapInArrow(run, with_fields(rows, ["key"], "text string")).withColumnRenamed("key", key_col)
