"""Benchmark decontamination by winnowing.

A window is ``SPAN`` consecutive words of a benchmark item, or the whole of an item of fewer words.  From each run of
``w`` consecutive k-grams both sides keep the smallest hash (the last one on ties), with k + w - 1 equal to the length of
the window; equal windows therefore keep the same fingerprint at the same place, so a join on fingerprints misses no
shared window.  Each hit is then extended over the windows that chose it, and those are compared word by word, so that
neither a k-gram shared by chance nor a collision of hashes counts.

Whether a row is contaminated depends on its text alone, so rows are judged by their texts: rows with equal ids, or none,
never stand for each other.  A benchmark of at most ``INDEX_BYTES`` (its UTF-8 bytes and ``ROW_BYTES`` for each item, checked
by an aggregate before anything is collected) is indexed once and broadcast, and the corpus is read in one narrow pass; the
index takes some six times that size.  A larger one goes through joins, with the same rows as result: a bitmap of fixed
size drops most fingerprints of the corpus, the others meet the benchmark's in a join, and only the texts with a shared
fingerprint are looked at again, by 128 bits of SHA-256, to extend those hits and compare their windows.

Nulls, empty texts and texts without words have no words and are clean.  Items with equal ids count as one item, and a null
``item_id`` marks words but counts as no item.  Ids of documents may have any type.  Further columns are ignored by
``find_contamination`` and kept by ``remove_contaminated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.llm.shared import fresh, use_checkpoint_dir, with_fields
from scriptorium.llm.textblock import ALNUM, LOWER, Grams, Words, blocks, found, packed

SPAN = 10
GRAM = 5
INDEX_BYTES, ROW_BYTES = 8 << 20, 64
#: Bits of the bitmap of the benchmark's fingerprints, as a power of two: 8 MB, whatever the benchmark.
FILTER_BITS = 26
SALTS = 16
RUNS = "array<struct<start:int,end:int>>"


def _shape(n: int) -> tuple[int, int]:
    """(k, w) for windows of n words."""
    k = min(GRAM, n)
    return k, n - k + 1


def _least(grams: np.ndarray, w: int, valid: np.ndarray) -> np.ndarray:
    """The place of the smallest of the w k-grams from each place in ``valid`` on, the last one on ties."""
    value, place = grams[valid], valid.copy()
    for s in range(1, w):
        other = grams[valid + s]
        less = other <= value
        value = np.where(less, other, value)
        place = np.where(less, valid + s, place)
    return place


def _item_starts(words: Words) -> Iterator[tuple[int, np.ndarray]]:
    """(n, first words) of the windows of items, by their length."""
    total, left = np.diff(words.first)[words.row()], words.left()
    for n in range(1, SPAN + 1):
        starts = np.flatnonzero((total == n) & (left == n) if n < SPAN else left >= n)
        if len(starts):
            yield n, starts


class Index:
    """The windows of a benchmark by length: their fingerprints, and for each distinct one its hash, a place in the items'
    words where it stands, and the items that hold it."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.names = sorted({str(i) for i, _ in items if i is not None})
        code = {name: k for k, name in enumerate(self.names)}
        owner = np.array([-1 if i is None else code[str(i)] for i, _ in items], np.int64)
        texts = [(t or "").encode() for _, t in items]
        raw = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        self.words = Words(raw, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), ALNUM)
        self.classes: dict[int, dict] = {}
        if not self.words.n:
            return
        grams, second, row = Grams(self.words.hashes()), Grams(self.words.hashes(1)), self.words.row()
        for n, starts in _item_starts(self.words):
            k, w = _shape(n)
            value = grams.of(k)
            h, g = grams.at(starts, n), second.at(starts, n)
            order = np.lexsort((g, h))
            h, g, starts = h[order], g[order], starts[order]
            new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
            window, own = np.cumsum(new) - 1, owner[row[starts]]
            pairs = np.unique(np.stack([window[own >= 0], own[own >= 0]], axis=1), axis=0)
            self.classes[n] = {"prints": np.unique(value[_least(value, w, starts)]), "hash": h[new], "at": starts[new], "owner": pairs[:, 1].astype(np.int32), "first": np.searchsorted(pairs[:, 0], np.arange(int(new.sum()) + 1))}

    def judge(self, raw: np.ndarray, at: np.ndarray) -> tuple[Words, np.ndarray, list[set]]:
        """The words of a block, whether each is hit, and the items (as numbers) found in each row."""
        words = Words(raw, at, ALNUM)
        hit, items = np.zeros(words.n + 1, np.int64), [set() for _ in range(len(at) - 1)]
        if not words.n:
            return words, hit[:0] > 0, items
        grams, left, row = Grams(words.hashes()), words.left(), words.row()
        for n, c in self.classes.items():
            k, w = _shape(n)
            starts = np.flatnonzero(left >= n)
            if not len(starts):
                continue
            value = grams.of(k)
            place = _least(value, w, starts)
            chosen = np.zeros(words.n, bool)
            chosen[place] = True
            chosen = np.flatnonzero(chosen)
            shared = np.zeros(words.n, bool)
            shared[chosen] = found(c["prints"], value[chosen])
            near = starts[shared[place]]
            value = grams.at(near, n)
            lo, hi = np.searchsorted(c["hash"], value, "left"), np.searchsorted(c["hash"], value, "right")
            some = np.flatnonzero(hi > lo)
            for i, a, b in zip(near[some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
                own = [words.bytes_of(j) for j in range(i, i + n)]
                for x in range(a, b):
                    p = int(c["at"][x])
                    if all(self.words.bytes_of(p + j) == own[j] for j in range(n)):
                        hit[i] += 1
                        hit[i + n] -= 1
                        items[row[i]].update(c["owner"][c["first"][x] : c["first"][x + 1]].tolist())
        return words, np.cumsum(hit[:-1]) > 0, items


def _runs(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]


_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_RESULT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("hit_runs", _RUNS)])


def _size(items: DataFrame) -> int:
    n, size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return (size or 0) + ROW_BYTES * n


def _collected(items: DataFrame):
    """The index of a benchmark that was found small, broadcast."""
    return items.sparkSession.sparkContext.broadcast(Index([(r[0], r[1]) for r in items.collect()]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document: words, words hit, items met, and the runs of words hit (word offsets, end exclusive)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    if _size(items) > index_bytes:
        return _by_joins(docs, items)
    shared = _collected(items)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for lo, hi, raw, at in blocks(batch.column("text")):
                words, hit, items = index.judge(LOWER[raw], at)
                cut, rows = words.first, []
                for i in range(hi - lo):
                    flags, names = hit[cut[i] : cut[i + 1]], [index.names[x] for x in sorted(items[i])]
                    n_hit = int(flags.sum())
                    rows.append({"n_words": int(cut[i + 1] - cut[i]), "n_hit": n_hit, "n_items": len(names), "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(), "contaminated": n_hit > 0, "items": names, "hit_runs": _runs(flags)})
                out = pa.RecordBatch.from_pylist(rows, _RESULT)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *out.columns], ["doc_id", *out.schema.names])

    return docs.mapInArrow(judge, with_fields(docs, ["doc_id"], f"n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hit_runs {RUNS}"))


# A benchmark of any size.


def text_key(text: Column) -> Column:
    """128 bits of SHA-256 of a text; a null is as good as an empty one."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) to (n, print, window, item_id)."""
    for batch in batches:
        for lo, _, raw, at in blocks(batch.column("text")):
            words = Words(LOWER[raw], at, ALNUM)
            if not words.n:
                continue
            grams, row = Grams(words.hashes()), words.row()
            for n, starts in _item_starts(words):
                k, w = _shape(n)
                value = grams.of(k)
                text = [b" ".join(words.bytes_of(j) for j in range(i, i + n)).decode() for i in starts.tolist()]
                own = batch.column("item_id").take(pa.array(row[starts] + lo))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), n, np.int32)), pa.array(value[_least(value, w, starts)].view(np.int64)), pa.array(text), own], ["n", "print", "window", "item_id"])


def _doc_prints(lengths: list[int], bitmap):
    """(key, text) to the (n, print, key, place) of the fingerprints that the benchmark may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = bitmap.value, np.uint64((1 << FILTER_BITS) - 1)
        for batch in batches:
            for lo, _, raw, at in blocks(batch.column("text")):
                words = Words(LOWER[raw], at, ALNUM)
                if not words.n:
                    continue
                grams, left, row = Grams(words.hashes()), words.left(), words.row()
                for n in lengths:
                    k, w = _shape(n)
                    starts = np.flatnonzero(left >= n)
                    if not len(starts):
                        continue
                    value = grams.of(k)
                    chosen = np.zeros(words.n, bool)
                    chosen[_least(value, w, starts)] = True
                    place = np.flatnonzero(chosen)
                    slot = value[place] & mask
                    place = place[(bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)) > 0]
                    own = batch.column("key").take(pa.array(row[place] + lo))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), n, np.int32)), pa.array(value[place].view(np.int64)), own, pa.array((place - words.first[row[place]]).astype(np.int32))], ["n", "print", "key", "place"])

    return run


_WINDOW = pa.schema([("key", pa.binary()), ("n_words", pa.int64()), ("n", pa.int32()), ("start", pa.int32()), ("window", pa.string())])


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, met: fingerprints as (n, place)) to the windows that chose one of those."""

    def rows():
        for batch in batches:
            for key, text, met in zip(batch.column("key"), batch.column("text"), batch.column("met"), strict=True):
                raw = LOWER[np.frombuffer((text.as_py() or "").encode(), np.uint8)]
                words = Words(raw, np.array([0, len(raw)]), ALNUM)
                grams, left = Grams(words.hashes()), words.left()
                size, place = (met.values.field(c).to_numpy() for c in ("n", "place"))
                for n in np.unique(size).tolist():
                    k, w = _shape(n)
                    starts = np.flatnonzero(left >= n)
                    shared = np.zeros(words.n, bool)
                    shared[place[size == n]] = True
                    for i in starts[shared[_least(grams.of(k), w, starts)]].tolist():
                        yield key.as_py(), words.n, n, i, b" ".join(words.bytes_of(j) for j in range(i, i + n)).decode()

    yield from packed(rows(), _WINDOW, lambda r: 40 + len(r[4]))


_HITS = pa.schema([("key", pa.binary()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit_runs", _RUNS)])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_words, hits as (start, n)) to the words hit, in runs."""

    def rows():
        for batch in batches:
            for key, total, hits in zip(*(batch.column(c) for c in ("key", "n_words", "hits")), strict=True):
                edge = np.zeros(total.as_py() + 1, np.int64)
                start, n = (hits.values.field(c).to_numpy() for c in ("start", "n"))
                np.add.at(edge, start, 1)
                np.add.at(edge, start + n, -1)
                flags = np.cumsum(edge[:-1]) > 0
                yield key.as_py(), total.as_py(), int(flags.sum()), _runs(flags)

    yield from packed(rows(), _HITS, lambda r: 40 + 16 * len(r[3]))


def _hit_texts(texts: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts: text.  Of the texts that hold a window: (key, n_words, n_hit, hit_runs), and (key, item_id) of the items met."""
    use_checkpoint_dir(texts.sparkSession)
    theirs = items.mapInArrow(_item_windows, "n int, print long, window string, item_id string").distinct().checkpoint()
    slots = theirs.select(F.col("print").bitwiseAND((1 << FILTER_BITS) - 1).alias("s")).groupBy(F.shiftright("s", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bitmap[slots.column("at").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)
    lengths = sorted(r[0] for r in theirs.select("n").distinct().collect())
    keyed = texts.select(text_key(F.col("text")).alias("key"), "text", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    prints = keyed.select("key", "text").mapInArrow(_doc_prints(lengths, texts.sparkSession.sparkContext.broadcast(bitmap)), "n int, print long, key binary, place int").distinct()
    met = prints.join(theirs.select("n", "print").distinct(), ["n", "print"], "left_semi").groupBy("key").agg(F.collect_list(F.struct("n", "place")).alias("met")).checkpoint()
    salted = met.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # copies of one text meet in SALTS tasks first
    once = keyed.join(salted, ["key", "salt"], "left_semi").dropDuplicates(["key"]).drop("salt")
    windows = once.join(met, "key").mapInArrow(_extended, "key binary, n_words long, n int, start int, window string")
    hits = windows.join(theirs.select("n", "window").distinct(), ["n", "window"], "left_semi").checkpoint()
    marked = hits.groupBy("key").agg(F.max("n_words").alias("n_words"), F.collect_list(F.struct("start", "n")).alias("hits")).mapInArrow(_merged, f"key binary, n_words long, n_hit long, hit_runs {RUNS}")
    named = theirs.where("item_id IS NOT NULL").select("n", "window", "item_id").distinct()
    return marked, hits.select("key", "n", "window").distinct().join(named, ["n", "window"]).select("key", "item_id").distinct()


def _by_joins(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same as with the index, for a benchmark of any size; nothing is collected but the bitmap."""
    marked, met = _hit_texts(docs.select("text"), items)
    named = met.groupBy("key").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    found_ = marked.drop("n_words").join(named, "key", "left").checkpoint()  # written, so that the join with all rows can be split

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(Words(LOWER[raw], at, ALNUM).first) for _, _, raw, at in blocks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))], ["doc_id", "key", "n_words"])

    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    counted = keyed.mapInArrow(count, with_fields(keyed, ["doc_id", "key"], "n_words long"))
    names, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0).cast("long"))
    return counted.join(found_, "key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        names.alias("items"), F.coalesce("hit_runs", F.array().cast(RUNS)).alias("hit_runs"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, max_share: float = 0.0, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The documents of which at most ``max_share`` of the words lie in benchmark windows, with all their columns."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    if _size(items) > index_bytes:
        marked, _ = _hit_texts(docs.select(F.col(text_col).alias("text")), items)
        (gone,) = fresh(docs.columns, "gone")
        drop = marked.where(F.col("n_hit") > max_share * F.col("n_words")).select(F.col("key").alias(gone))
        return docs.join(drop, text_key(F.col(text_col)) == F.col(gone), "left_anti")
    shared = _collected(items)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = np.zeros(batch.num_rows, bool)
            for lo, hi, raw, at in blocks(batch.column(text_col)):
                words, hit, _ = shared.value.judge(LOWER[raw], at)
                count = np.concatenate([[0], np.cumsum(hit)])[words.first]
                mask[lo:hi] = np.diff(count) <= max_share * np.diff(words.first)
            yield batch.filter(pa.array(mask))

    return docs.mapInArrow(keep, docs.schema)
