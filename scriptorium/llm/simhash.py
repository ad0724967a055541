"""SimHash near-duplicates by multi-index hashing.

Whole texts, A-Z lower-cased, are cut at ASCII white space into words; the words' 4-grams (repeats included; the whole
sequence if it is shorter) are hashed with XXH64, seed 42, and a bit of the 64-bit fingerprint is set if it is set in over
half the hashes.  A text without words has fingerprint zero.  Fingerprints at most ``RADIUS`` bits apart are linked, and a
component is what links connect.

Exact copies fall together first, by a map-side combined aggregate on the fingerprint, so a hot text costs one row.  A
fingerprint is then split into segments, each with a radius such that any two linked fingerprints agree to within that
radius in one segment at least; every fingerprint is stored in one table per segment and probes each table with the small
Hamming ball about its own segment, and the join keeps a pair only if the whole distance holds, in the first segment that
can find it.  ``plan`` chooses the segments from the number of distinct fingerprints, to balance probes against chance
matches; every choice finds the same links.

Large groups of near copies are first drawn together: each fingerprint in a crowded segment emits itself and its 64
neighbours at one bit, and all that meet at a value are at most two bits apart, so one link to the smallest suffices for
each.  The join over segments then skips pairs already connected, so it does not emit all pairs of a group.  Where more than
``MOST_TOGETHER`` fingerprints have one value of a segment, they are indexed once more, by segments of their other bits, so
that no value's members are compared with each other one by one.

``similar`` uses the same index at a wider radius, by ``draws`` and ``pairs``, over fingerprints of sets (``majority``).

A null text counts as empty.  Ids may have any type that can be ordered.  A component of null ids only has a null ``component_id``; rows with equal ids get equal rows.
Further columns are ignored by ``near_duplicates`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from scriptorium.llm.components import connect
from scriptorium.llm.shared import fresh, use_checkpoint_dir, with_fields, written
from scriptorium.llm.textblock import LOWER, NOT_SPACE, Words, blocks

RADIUS = 4
SHINGLE = 4
#: A segment's value is crowded if so many fingerprints more than twice the average have it.  A group's members meet the least
#: of them in so many tasks.
CROWD, SALTS = 32, 16
#: So many fingerprints with one value of a segment are compared directly; more by segments of their other bits.
MOST_TOGETHER = 4096
#: Segments as (bits, radius), low bits first.  In each row the radii plus one add up to more than RADIUS.
PLANS = (((19, 0), (22, 1), (23, 1)), ((29, 1), (35, 2)))
#: Further segments for ``similar``, which looks for fingerprints so many bits apart.
WIDE = 7
WIDE_PLANS = (((16, 1),) * 4, ((21, 2), (21, 2), (22, 1)), ((32, 3), (32, 3)))


def fingerprints(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of a block, as uint64."""
    words = Words(LOWER[raw], at, NOT_SPACE)
    out = np.zeros(len(at) - 1, np.uint64)
    one = xxhash.xxh64_intdigest
    size = words.end - words.start
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if a == b:
            continue
        ends = np.cumsum(size[a:b] + 1)
        text = b" ".join(LOWER[raw[at[i] : at[i + 1]]].tobytes().split())
        n = max(1, b - a - SHINGLE + 1)
        stop = (ends[min(SHINGLE, b - a) - 1 :] - 1).tolist()
        start = [0, *ends[: n - 1].tolist()]
        hashes = np.fromiter((one(text[s:e], 42) for s, e in zip(start, stop, strict=True)), np.uint64, n)
        ones = np.zeros(64, np.int64)
        for lo in range(0, n, 65536):
            ones += np.unpackbits(hashes[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def majority(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The fingerprint of each row's hashes, which lie one row after the other from ``first`` on; zero of a row without any."""
    size = np.diff(first)
    some = np.flatnonzero(size)
    out, made = np.zeros(len(size), np.uint64), np.zeros(len(some), np.uint64)
    for b in range(64 if len(some) else 0):
        ones = np.add.reduceat((value >> np.uint64(b)) & np.uint64(1), first[some])
        made |= (2 * ones > size[some].astype(np.uint64)).astype(np.uint64) << np.uint64(b)
    out[some] = made
    return out


def _with_print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            made = np.concatenate([fingerprints(raw, at) for _, _, raw, at in blocks(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(made.view(np.int64))], ["doc_id", "mark", "fp"])


def plan(n: int, radius: int = RADIUS) -> tuple[tuple[int, int], ...]:
    """The segments that cost least for n distinct fingerprints: a probe costs about 30 comparisons."""
    ball = lambda bits, r: sum(math.comb(bits, i) for i in range(r + 1))
    return min({RADIUS: PLANS, WIDE: WIDE_PLANS}[radius], key=lambda p: sum(ball(b, r) * (30 + n / 2.0**b) for b, r in p))


def _ball(seg: str, bits: int, r: int) -> str:
    """SQL for the array of values within r bits of a segment."""
    parts = [f"array({seg})"]
    if r >= 1:
        parts.append(f"transform(sequence(0, {bits - 1}), i -> {seg} ^ shiftleft(1L, i))")
    if r >= 2:
        parts.append(f"flatten(transform(sequence(1, {bits - 1}), i -> transform(sequence(0, i - 1), j -> {seg} ^ shiftleft(1L, i) ^ shiftleft(1L, j))))")
    if r >= 3:
        three = f"transform(sequence(0, j - 1), k -> {seg} ^ shiftleft(1L, i) ^ shiftleft(1L, j) ^ shiftleft(1L, k))"
        parts.append(f"flatten(transform(sequence(2, {bits - 1}), i -> flatten(transform(sequence(1, i - 1), j -> {three}))))")
    return f"concat({', '.join(parts)})"


def _tables(n: int, radius: int = RADIUS) -> tuple[list[str], list[str], list[tuple[int, int]]]:
    """SQL, for each segment, for its value and for the array of values to probe, both with the segment's number above; and
    the segments' masks and radii."""
    low, tables, probes, masks = 0, [], [], []
    for s, (bits, r) in enumerate(plan(n, radius)):
        seg = f"(shiftrightunsigned(fp, {low}) & {(1 << bits) - 1}L)"
        tag = f"{s << 48}L"
        tables.append(f"{seg} | {tag}")
        probes.append(f"transform({_ball(seg, bits, r)}, x -> x | {tag})")
        masks.append((((1 << bits) - 1) << low, r))
        low += bits
    return tables, probes, masks


def _crowded(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """The fingerprints that share a segment's value with many others."""
    most = ", ".join(f"{CROWD + (2 * n >> bits)}" for bits, _ in plan(n, radius))
    at = distinct.select("fp", F.expr(f"explode(array({', '.join(_tables(n, radius)[0])}))").alias("at"))
    crowd = at.groupBy("at").agg(F.count("*").alias("m")).where(f"m > element_at(array({most}), cast(shiftright(at, 48) as int) + 1)")
    return at.join(crowd, "at", "left_semi").select("fp").distinct()


def _close(crowded: DataFrame) -> DataFrame:
    """Links a > b that connect all fingerprints at most two bits apart: those that meet at a value go to the least of them."""
    near = crowded.select("fp", F.explode(F.expr(_ball("fp", 64, 1))).alias("at")).repartition("at")
    least = near.groupBy("at").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").drop("top")
    return near.join(least, "at").where("fp > b").select(F.col("fp").alias("a"), "b")


def _links(labelled: DataFrame, n: int, most: int = MOST_TOGETHER, radius: int = RADIUS, key: str = "fp") -> DataFrame:
    """Links between fingerprints of different groups, as pairs of their keys; labelled: fp, grp and, if it isn't fp, the key."""
    tables, probes, masks = _tables(n, radius)
    of = lambda x: x if key == "fp" else f"key_{x}"
    side = lambda x: [F.col("fp").alias(x), F.col("grp").alias(f"grp_{x}")] + [F.col(key).alias(of(x))] * (key != "fp")
    pair = [F.col(of("a")).alias("a"), F.col(of("b")).alias("b")]
    table = labelled.select(F.expr(f"explode(array({', '.join(tables)}))").alias("at"), *side("b"))
    probe = labelled.select(F.expr(f"explode(concat({', '.join(probes)}))").alias("at"), *side("a"))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    earlier = " AND ".join(f"(shiftright(p.at, 48) <= {s} OR bit_count((a ^ b) & {signed(m)}L) > {r})" for s, (m, r) in enumerate(masks[:-1]))
    near = f"p.at = t.at AND {of('a')} > {of('b')} AND grp_a <> grp_b AND bit_count(a ^ b) <= {radius} AND {earlier}"
    many = written(table.groupBy("at").agg(F.count("*").alias("m")).where(F.col("m") > most).select("at"))
    if many.isEmpty():
        return probe.alias("p").join(table.alias("t"), F.expr(near)).select(*pair)
    few = probe.join(many, "at", "left_anti").alias("p").join(table.join(many, "at", "left_anti").alias("t"), F.expr(near)).select(*pair)
    # of what agrees in one segment, the other bits are cut into segments of their own
    sub_table, sub_probe = zip(*(_others(bits, low, radius) for bits, low in _places(n, radius)), strict=True)
    by = lambda each, fp: "CASE " + " ".join(f"WHEN shiftright(at, 48) = {s} THEN {e.replace('fp', fp)}" for s, e in enumerate(each)) + " END"
    tables_in = table.join(many, "at", "left_semi").select("*", F.explode(F.expr(by(sub_table, "b"))).alias("sub"))
    probes_in = probe.join(many, "at", "left_semi").select("*", F.explode(F.expr(by(sub_probe, "a"))).alias("sub"))
    return few.union(probes_in.alias("p").join(tables_in.alias("t"), F.expr(f"p.sub = t.sub AND {near}")).select(*pair).distinct())


def _places(n: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(bits, lowest bit) of the segments."""
    out, low = [], 0
    for bits, _ in plan(n, radius):
        out.append((bits, low))
        low += bits
    return out


def _others(bits: int, low: int, radius: int = RADIUS) -> tuple[str, str]:
    """SQL, over the bits outside a segment cut in three, for the arrays of values to store and to probe; the radii plus one add
    up to more than the radius once more."""
    rest = f"((fp & {(1 << low) - 1}L) | shiftleft(shiftrightunsigned(fp, {low + bits}), {low}))" if low + bits < 64 else f"(fp & {(1 << low) - 1}L)"
    size = 64 - bits
    cuts = [0, size // 3, 2 * size // 3, size]
    store, probe = [], []
    for k, r in enumerate((radius + 1 + k) // 3 - 1 for k in range(3)):
        seg = f"(shiftrightunsigned({rest}, {cuts[k]}) & {(1 << cuts[k + 1] - cuts[k]) - 1}L)"
        store.append(f"{seg} | {k << 48}L")
        probe.append(f"transform({_ball(seg, cuts[k + 1] - cuts[k], r)}, x -> x | {k << 48}L)")
    return f"array({', '.join(store)})", f"concat({', '.join(probe)})"


def draws(prints: DataFrame, n: int) -> DataFrame:
    """Pairs (a, b) of keys that draw crowds together: each key and the least of its fingerprint, and the least keys of crowded
    fingerprints that meet at one bit from both.  prints: key, fp; n: how many."""
    least = written(prints.groupBy("fp").agg(F.min("key").alias("least"), F.max("key").alias("top")))
    same = prints.join(least.where("least < top"), "fp").where("key > least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    side = lambda x: least.select(F.col("fp").alias(x), F.col("least").alias(f"key_{x}"))
    near = _close(_crowded(least.select("fp"), n, WIDE)).distinct().join(side("a"), "a").join(side("b"), "b")
    return same.union(near.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))


def pairs(labelled: DataFrame, n: int, most: int = MOST_TOGETHER) -> DataFrame:
    """All pairs (a, b) of keys of different groups whose fingerprints are at most WIDE bits apart; labelled: key, fp, grp; n: how
    many."""
    return _links(labelled, n, most, WIDE, "key")


def components(distinct: DataFrame) -> DataFrame:
    """(fp, root) for the fingerprints that are linked to another; root is the component's smallest value as a long.
    distinct: fp, each once, cheap to read again (a checkpoint)."""
    n = distinct.count()
    close = connect(_close(_crowded(distinct, n)))
    grouped = distinct.join(close.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("grp"))
    own = close.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return connect(_links(grouped, n).union(own)).withColumnRenamed("node", "fp")


def _members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (a hash of the text), fp, root (of the component) and component_id of every row."""
    use_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    prints = written(rows.mapInArrow(_with_print, with_fields(rows, ["doc_id"], "mark long, fp long")))
    own = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return prints.join(with_component(own, components(own.select("fp")), "fp"), "fp")


def with_component(own: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """(key, root, component_id) of every row of ``own``, key and least; linked: (key, root) of the keys that have a link.  The
    members of a large group meet their component's least in SALTS tasks.  The result is written, so that a join with it can be
    split where a key is hot."""
    linked = own.join(linked, key).select(key, "root", "least")
    best = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = linked.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(best.hint("merge"), ["root", "salt"]).select(key, "root", "component_id")
    alone = F.col("root").isNull()
    return written(own.join(found, key, "left").select(key, F.coalesce("root", key).alias("root"), F.when(alone, F.col("least")).otherwise(F.col("component_id")).alias("component_id")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the component's smallest doc_id)."""
    return _members(docs, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_key(rows: DataFrame, id_col: str, mark: Column, names: list[str]) -> list[Column]:
    """Three columns that tell rows apart and can be joined by name: whether the id is null, the id or something in its place,
    and a mark of the text."""
    own = F.col(id_col)
    whole = isinstance(rows.select(own).schema[0].dataType, T.IntegralType)
    held = F.coalesce(own.cast("long"), F.lit(0)) if whole else F.coalesce(own.cast("string"), F.lit(""))
    return [own.isNull().alias(names[0]), held.alias(names[1]), mark.alias(names[2])]


def keep_one(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each component; members: doc_id, mark, root and component_id of every row."""
    found = members.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("mark").alias("mark"))
    on = fresh(docs.columns, "none", "id", "mark")
    marked = docs.select("*", *row_key(docs, id_col, F.xxhash64(text_col), on))
    return marked.join(kept.select(*row_key(kept, "doc_id", F.col("mark"), on)), on, "left_semi").dropDuplicates(on).select(*docs.columns)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without near duplicates: one row of each component stays.  It is the one with the smallest
    doc_id; where rows share that id, or a component has none, the one whose text has the smallest hash."""
    return keep_one(docs, _members(docs, id_col, text_col), id_col, text_col)
