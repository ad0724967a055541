"""Exact substring deduplication over words by fixed-block anchors.

A window is ``SPAN`` consecutive words of one document.  A word goes if a window that covers it has a word sequence that also
starts earlier: in a document with a smaller id, or earlier in the same one.

Blocks are the ``BLOCK`` words that begin at every multiple of ``BLOCK`` in a document; any window holds one whole block, as
SPAN >= 2 * BLOCK - 1.  Every rolling run of BLOCK words probes the index of blocks.  If two windows are equal, each holds
the other's block at the same place, so both get a hit from elsewhere: windows without a hit are unique and go no further.
A hit is then extended: every window that holds it is compared over its whole length, by 128 bits of two independent hashes
of its words, and the repeated ones together are the maximal exact repeats.

Nothing is compared pair by pair, and a passage with k copies costs k rows.  Documents are dealt once, compressed, into
chunks of whole texts by a hash.  A chunk first folds its own equal hashes together, and only then sends them on, packed into one
binary row for each chunk and range of hash values: (hash, blocks here, runs here).  Each range says which hashes are hit;
the chunks answer with the hashes of the windows about the hits and the first place where each starts, and each range says
for which of them another chunk has an earlier place.  A hash that a third of all documents hold thus costs one entry per
chunk.  Hashes have 44 bits for probes, where a chance match costs a comparison only, and 128 for windows, which decide.
Numbers are packed byte plane by byte plane, so that what sorted or small numbers share is squeezed out of the shuffle.  A range
holds its messages, unpacked, and works through them by the hashes' order, about ``PASS`` entries at a time.

Null texts and texts of fewer than SPAN words keep all words.  Rows with equal ids are ordered by a hash of id and text,
whose upper bits are also the chunk; equal rows fall into one chunk and are ordered by their place there.  Null ids come before all others, in the order of
their texts' hashes.  Ids must be whole numbers, since their order decides; others are refused before the job starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.shared import whole_ids
from scriptorium.llm.textblock import BLOCK_BYTES, NOT_SPACE, Grams, Words, found, utf8

SPAN = 20
BLOCK = 10
#: Bytes of text in a chunk, on average.
CHUNK_BYTES = 14 << 20
#: Shuffle partitions and hash ranges at most; beyond, a task works through several chunks, and a range grows.
MOST_TASKS, MOST_RANGES = 20_000, 1 << 18
#: A range works on about so many entries at a time.
PASS = 1 << 22
#: Probe entries: 44 bits of the hash above 4 that carry how many blocks (0 to 2) and runs (1 or 2) there are.
_SHIFT, _KEY = np.uint64(16), np.uint64(0xFFFFFFFFFFF0)
#: Bytes of the numbers in each kind of message.
_PROBE, _PLACE, _LATER = (6,), (8, 8, 8, 4), (8, 8)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, at, mark, known, text) to one compressed row per batch and chunk: numbers, lengths, and the texts."""
    press = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        raw, offset = utf8(b.column("text"))
        chunk, known = b.column("chunk").to_numpy(), b.column("known").to_numpy(zero_copy_only=False).astype(np.int64)
        at, mark, size = b.column("at").to_numpy(), b.column("mark").to_numpy(), np.diff(offset)
        order = np.argsort(chunk, kind="stable")
        cuts = np.flatnonzero(np.diff(chunk[order])) + 1
        blobs = []
        for rows in np.split(order, cuts) if len(order) else []:
            head = np.concatenate([[len(rows)], at[rows], mark[rows], known[rows], size[rows]]).astype(np.int64).tobytes()
            blobs.append(press(head + b"".join(raw[offset[i] : offset[i + 1]].tobytes() for i in rows)))
        yield pa.RecordBatch.from_arrays([pa.array(chunk[order[np.append(0, cuts)]] if len(order) else [], pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "blob"])


class Chunk:
    """The documents of a chunk, in the order that decides which of two windows is earlier."""

    def __init__(self, table: pa.Table):
        numbers, texts = [np.zeros((4, 0), np.int64)], []
        unpack = zstandard.ZstdDecompressor()
        for blob in table.column("blob"):
            data = unpack.decompress(blob.as_py())
            n = int(np.frombuffer(data, np.int64, 1)[0])
            own = np.frombuffer(data, np.int64, 4 * n, 8).reshape(4, n)
            numbers.append(own)
            stop = 8 + 32 * n + np.cumsum(own[3])
            view = memoryview(data)
            texts += [view[e - k : e] for e, k in zip(stop.tolist(), own[3].tolist(), strict=True)]
        at, marks, known, _ = np.concatenate(numbers, axis=1)
        order = np.lexsort((marks, at))
        self.ids, self.known, self.texts = at[order], known[order].astype(bool), [texts[i] for i in order.tolist()]

    def parts(self) -> Iterator[tuple[int, Words, Grams]]:
        lo = 0
        while lo < len(self.texts):
            hi, size = lo, 0
            while hi < len(self.texts) and (hi == lo or size + len(self.texts[hi]) <= BLOCK_BYTES):
                size += len(self.texts[hi])
                hi += 1
            raw = np.frombuffer(b"".join(self.texts[lo:hi]), np.uint8)
            words = Words(raw, np.concatenate([[0], np.cumsum([len(t) for t in self.texts[lo:hi]])]).astype(np.int64), NOT_SPACE)
            yield lo, words, Grams(words.hashes())
            lo = hi

    def probes(self) -> np.ndarray:
        """The distinct hashes of all runs of BLOCK words, in order, with the number of blocks and of runs of each."""
        keys, block = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for _, words, grams in self.parts():
            at = np.flatnonzero(words.left() >= BLOCK)
            keys.append(grams.of(BLOCK)[at] >> _SHIFT & _KEY)
            block.append(((at - words.first[words.row()[at]]) % BLOCK == 0).astype(np.uint64))
        every = np.concatenate(keys) | np.concatenate(block)
        every.sort()
        return _summed(every & _KEY, every & np.uint64(3), np.uint64(1))

    def windows(self, hits: np.ndarray) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray, np.ndarray]]:
        """For each part: its first row, words, the starts of windows that hold a hit, and their two hashes.  hits: hashes
        of which there is a block, with the number of blocks; of one block alone, that block itself is not hit."""
        keys = hits & _KEY
        twice = keys[(hits & np.uint64(3)) == 2]
        for lo, words, grams in self.parts():
            left = words.left()
            at = np.flatnonzero(left >= BLOCK)
            own = (at - words.first[words.row()[at]]) % BLOCK == 0
            probe = grams.of(BLOCK)[at] >> _SHIFT & _KEY
            marked = np.zeros(words.n + 1, np.int64)
            marked[at[np.where(own, found(twice, probe), found(keys, probe))] + 1] = 1
            total = np.cumsum(marked)
            start = np.flatnonzero(left >= SPAN)
            start = start[total[start + SPAN - BLOCK + 1] > total[start]]
            yield lo, words, start, grams.at(start, SPAN), Grams(words.hashes(1)).at(start, SPAN) if len(start) else np.zeros(0, np.uint64)


def _summed(keys: np.ndarray, n_block: np.ndarray, n_run: np.ndarray) -> np.ndarray:
    """Sorted keys folded: each once, with the number of blocks and of runs, 2 at most."""
    if not len(keys):
        return keys
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    two = np.uint64(2)
    runs = np.add.reduceat(np.broadcast_to(n_run, keys.shape), first)
    return keys[first] | np.minimum(np.add.reduceat(n_block, first), two) | np.minimum(runs, two) << two



def _packed(columns: list[np.ndarray], widths: tuple[int, ...]) -> bytes:
    """Numbers of 64 bits, each column as its ``widths`` lower bytes, one plane of bytes after the other."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for c, w in zip(columns, widths, strict=True))


def _split(blobs: list[bytes], widths: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all blobs end to end, as uint64, and each entry's blob."""
    sizes = [len(x) // sum(widths) for x in blobs]
    edge = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = [np.zeros((edge[-1], 8), np.uint8) for _ in widths]
    for blob, lo, hi in zip(blobs, edge[:-1], edge[1:], strict=True):
        at = 0
        for c, w in zip(out, widths, strict=True):
            c[lo:hi, :w] = np.frombuffer(blob, np.uint8, w * (hi - lo), at).reshape(w, hi - lo).T
            at += w * (hi - lo)
    return [c.view(np.uint64).reshape(-1) for c in out], np.repeat(np.arange(len(blobs)), sizes)


def _answers(chunks: list[int], owner: np.ndarray, columns: list[np.ndarray], widths: tuple[int, ...]) -> pa.Table:
    """A (chunk, blob) row for each owner that has entries."""
    order = np.argsort(owner, kind="stable")
    columns, edge = [c[order] for c in columns], np.searchsorted(owner[order], np.arange(len(chunks) + 1))
    rows = [(c, _packed([x[i:j] for x in columns], widths)) for c, i, j in zip(chunks, edge[:-1], edge[1:], strict=True) if j > i]
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})


def _passes(group: pa.Table, widths: tuple[int, ...], most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The columns of all messages and each entry's message, in runs of the first column's values, by which messages are sorted.
    What differs in the lowest 4 bits only, where probes have their counts, is never in two runs."""
    blobs = group.column("blob").to_pylist()
    total = sum(len(x) // sum(widths) for x in blobs)
    if total <= most:
        yield _split(blobs, widths)
        return
    held = [_split([x], widths)[0] for x in blobs]
    del blobs
    lo, hi = (int(f(int(h[0][i]) for h in held if len(h[0]))) for f, i in ((min, 0), (max, -1)))
    n = -(-total // most)
    cuts = [np.searchsorted(h[0], np.array([lo + (hi - lo + 1) * k // n & -16 for k in range(n)], np.uint64)).tolist() + [len(h[0])] for h in held]
    for k in range(n):
        parts = [[c[at[k] : at[k + 1]] for c in h] for h, at in zip(held, cuts, strict=True)]
        yield [np.concatenate(c) for c in zip(*parts, strict=True)], np.repeat(np.arange(len(held)), [len(p[0]) for p in parts])


def _which_hit(group: pa.Table, most: int = PASS) -> pa.Table:
    """To each chunk of a range: its hashes of which there is a block and another run, with the number of blocks."""
    out = []
    for (entries,), owner in _passes(group, _PROBE, most):
        order = np.argsort(entries, kind="stable")
        entries, owner = entries[order], owner[order]
        keys = entries & _KEY
        total = _summed(keys, entries & np.uint64(3), entries >> np.uint64(2) & np.uint64(3))
        total = total[((total & np.uint64(3)) >= 1) & ((total >> np.uint64(2) & np.uint64(3)) >= 2)]
        hit = found(total & _KEY, keys)
        answer = total[np.searchsorted(total & _KEY, keys[hit])] & ~np.uint64(12)
        out.append(_answers(group.column("chunk").to_pylist(), owner[hit], [answer], _PROBE))
    return pa.concat_tables(out)


def _which_later(group: pa.Table, most: int = PASS) -> pa.Table:
    """To each chunk of a range: its windows of which another chunk has the earlier place."""
    out = []
    for (a, b, ids, place), owner in _passes(group, _PLACE, most):
        order = np.lexsort((place, group.column("chunk").to_numpy()[owner], ids.view(np.int64), b, a))
        a, b, owner = a[order], b[order], owner[order]
        later = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
        out.append(_answers(group.column("chunk").to_pylist(), owner[later], [a[later], b[later]], _LATER))
    return pa.concat_tables(out)


def _in_pairs(told: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each (a, b) is among the told pairs."""
    order = np.lexsort((told[1], told[0]))
    ta, tb = told[0][order], told[1][order]
    out = np.zeros(len(a), bool)
    at, end = np.searchsorted(ta, a, "left"), np.searchsorted(ta, a, "right")
    while (live := np.flatnonzero(at < end)).size:  # more than once only where first hashes collide
        out[live] |= tb[at[live]] == b[live]
        at[live] += 1
    return out


class Windows:
    """The windows of a chunk that hold a hit: parts, hash pairs, and whether the pair came before in the chunk."""

    def __init__(self, chunk: Chunk, hits: np.ndarray):
        self.parts = [(lo, words, start, len(start)) for lo, words, start, a, b in self._kept(chunk.windows(hits))]
        self.a, self.b = np.concatenate(self._a), np.concatenate(self._b)
        order = np.lexsort((np.arange(len(self.a)), self.b, self.a))
        self.before = np.zeros(len(self.a), bool)
        self.before[order[1:]] = (self.a[order[1:]] == self.a[order[:-1]]) & (self.b[order[1:]] == self.b[order[:-1]])

    def _kept(self, windows):
        self._a, self._b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for part in windows:
            self._a.append(part[3])
            self._b.append(part[4])
            yield part

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Each window's document (row of the chunk) and word."""
        rows = [np.zeros(0, np.int64), *(lo + words.row()[start] for lo, words, start, _ in self.parts)]
        return np.concatenate(rows), np.concatenate([np.zeros(0, np.int64), *(start - words.first[words.row()[start]] for _, words, start, _ in self.parts)])


def _sent(chunk: int, columns: list[np.ndarray], widths: tuple[int, ...], ranges: int) -> pa.Table:
    """The rows that a chunk sends to the ranges; the first column is sorted and its upper 32 bits deal the entries out."""
    upper = columns[0] >> np.uint64(8 * widths[0] - 32)
    edge = np.searchsorted(upper * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(edge)).tolist()
    blobs = [_packed([c[edge[r] : edge[r + 1]] for c in columns], widths) for r in full]
    return pa.table({"part": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()), "blob": pa.array(blobs, pa.binary())})


def mark_repeats(docs: DataFrame, kernel, schema: pa.Schema, *, id_col: str = "doc_id", text_col: str = "text", chunks: int | None = None) -> DataFrame:
    """Apply ``kernel(id, words, first, end, kept)`` to every document; it returns a row of ``schema`` as a dict."""
    rows = docs.select(whole_ids(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    n = chunks or max(8, (docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // CHUNK_BYTES)
    tasks, ranges = min(n, MOST_TASKS), min(4 * n, MOST_RANGES)
    rows = rows.withColumn("at", F.coalesce("doc_id", F.expr("(mark & 4611686018427387903L) | -9223372036854775808")))  # the order of documents
    rows = rows.withColumn("mark", F.xxhash64("at", "mark"))
    chunk = F.shiftright(F.shiftrightunsigned("mark", 32) * F.lit(n).cast("long"), 32)  # n is below 2**31
    rows = rows.select(chunk.alias("chunk"), "at", F.expr("mark ^ -9223372036854775808L").alias("mark"), F.col("doc_id").isNotNull().alias("known"), "text")
    by_chunk = rows.mapInArrow(_dealt, "chunk long, blob binary").repartition(tasks, "chunk")

    def probes(key, table):
        return _sent(key[0].as_py(), [Chunk(table).probes()], _PROBE, ranges)

    def hashes(answers: pa.Table, kind: int) -> list[bytes]:
        return [x for x, k in zip(answers.column("blob").to_pylist(), answers.column("kind").to_pylist(), strict=True) if k == kind]

    def places(key, table, answers):
        chunk = Chunk(table)
        windows = Windows(chunk, np.sort(_split(answers.column("blob").to_pylist(), _PROBE)[0][0]))
        row, place = windows.places()
        new = np.flatnonzero(~windows.before)
        new = new[np.argsort(windows.a[new], kind="stable")]
        return _sent(key[0].as_py(), [windows.a[new], windows.b[new], chunk.ids[row[new]], place[new]], _PLACE, ranges)

    def judged(key, table, answers):
        chunk = Chunk(table)
        windows = Windows(chunk, np.sort(_split(hashes(answers, 0), _PROBE)[0][0]))
        gone = windows.before | _in_pairs(tuple(_split(hashes(answers, 1), _LATER)[0]), windows.a, windows.b)
        out, at = [], 0
        for lo, words, start, n_own in windows.parts:
            first = start[gone[at : at + n_own]]
            at += n_own
            edge = np.zeros(words.n + 1, np.int64)
            edge[first] += 1
            edge[first + SPAN] -= 1
            kept = np.cumsum(edge[:-1]) == 0
            for i, (x, y) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                out.append(kernel(int(chunk.ids[lo + i]) if chunk.known[lo + i] else None, words, x, y, kept[x:y]))
        return pa.Table.from_pylist(out, schema)

    group = "part int, chunk long, blob binary"
    answer = "chunk long, blob binary"
    sent = by_chunk.groupBy("chunk").applyInArrow(probes, group)
    hits = sent.repartition(tasks, "part").groupBy("part").applyInArrow(lambda group: _which_hit(group), answer)
    placed = by_chunk.groupBy("chunk").cogroup(hits.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(places, group)
    later = placed.repartition(tasks, "part").groupBy("part").applyInArrow(lambda group: _which_later(group), answer)
    told = hits.withColumn("kind", F.lit(0)).unionByName(later.withColumn("kind", F.lit(1))).repartition(tasks, "chunk")
    out = ", ".join(f"{f.name} {'string' if pa.types.is_string(f.type) else 'long'}" for f in schema)
    return by_chunk.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(judged, out)


def _row(doc_id, words: Words, x: int, y: int, kept: np.ndarray) -> tuple[dict, bytes]:
    text = b" ".join(words.bytes_of(i) for i in (x + np.flatnonzero(kept)).tolist())
    return {"doc_id": doc_id, "n_words": y - x, "n_removed": int(y - x - np.count_nonzero(kept))}, text


def _digest(*args) -> dict:
    row, text = _row(*args)
    return row | {"kept_sha256": hashlib.sha256(text).hexdigest()}


def _text(*args) -> dict:
    row, text = _row(*args)
    return row | {"text": text.decode()}


_COUNTS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64())]


def removal_digests(docs: DataFrame, **names) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the SHA-256 of the kept words, joined by one space."""
    return mark_repeats(docs, _digest, pa.schema([*_COUNTS, ("kept_sha256", pa.string())]), **names)


def without_repeats(docs: DataFrame, **names) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the kept words, joined by one space."""
    return mark_repeats(docs, _text, pa.schema([*_COUNTS, ("text", pa.string())]), **names)
