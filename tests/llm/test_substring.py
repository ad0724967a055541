import hashlib
import re
from collections import Counter

import pytest

from scriptorium.llm import substring as S


def by_hand(docs):
    """docs: (order, id, text); rows of (id, words, removed, digest)."""
    first, out = {}, []
    parsed = [(o, i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for o, i, t in sorted(docs, key=lambda d: d[0])]
    for _, i, ws in parsed:
        gone = set()
        for p in range(len(ws) - 19):
            w = tuple(ws[p : p + 20])
            if w in first:
                gone |= set(range(p, p + 20))
            else:
                first[w] = True
        out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(w for p, w in enumerate(ws) if p not in gone).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("chunks", [1, 3, 40])
def test_against_brute_force(spark, edge, chunks):
    from pyspark.sql import functions as F

    marks = edge.select("doc_id", "text", F.xxhash64("text").alias("m"), F.xxhash64("doc_id", F.xxhash64("text")).alias("o")).collect()
    docs = [((0, r.m & (2**62 - 1)) if r.doc_id is None else (1, r.doc_id, r.o % 2**64), r.doc_id, r.text) for r in marks]
    got = S.removal_digests(edge, chunks=chunks).collect()
    assert Counter(tuple(r) for r in got) == by_hand(docs)


def test_repeats_within_and_across(spark):
    import random

    r = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for i in range(60):
        ws = [f"x{r.randrange(40)}" for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            a = r.randrange(40)
            at = r.randint(0, len(ws))
            ws[at:at] = passage[a : a + r.randint(15, 30)]
        docs.append((i, i, " ".join(ws)))
    docs.append((60, 60, "same " * 200))
    df = spark.createDataFrame([(i, t) for _, i, t in docs], "doc_id long, text string")
    for chunks in (1, 7):
        assert Counter(tuple(x) for x in S.removal_digests(df, chunks=chunks).collect()) == by_hand(docs)
    text = {x.doc_id: x.text for x in S.without_repeats(df).collect()}
    assert text[60] == "same"


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


@pytest.mark.parametrize("size", [8, 64, 1024, 2048])
def test_words_made_to_collide(spark, size):
    """A sequence and its mirror collide under any polynomial modulo 2**64; here they are told apart."""
    a = thue_morse(size)
    b = a.translate(str.maketrans("ab", "ba"))
    lead = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{lead} {a}"), (2, f"{lead} {b}"), (3, f"{lead} {a}")], "doc_id long, text string")
    for chunks in (1, 5):
        assert {r.doc_id: r.n_removed for r in S.removal_digests(df, chunks=chunks).collect()} == {1: 0, 2: 0, 3: 20}


def test_word_hashes_are_independent():
    import numpy as np

    from scriptorium.llm.textblock import NOT_SPACE, Words

    text = " ".join([thue_morse(k) for k in (8, 16, 256, 1024)] + [f"{i:x}" * (i % 30 + 1) for i in range(5000)] + ["ab" * 40, "ba" * 40, "x" * 64, "x" * 65]).encode()
    raw = np.frombuffer(text, np.uint8)
    words = Words(raw, np.array([0, len(raw)]), NOT_SPACE)
    own = {words.bytes_of(i) for i in range(words.n)}
    for seed in (0, 1):
        h = words.hashes(seed)
        assert len(set(h.tolist())) == len(own)
        by = {}
        assert all(by.setdefault(words.bytes_of(i), v) == v for i, v in enumerate(h.tolist()))
    assert not np.intersect1d(words.hashes(0), words.hashes(1)).size


def test_ranges_in_passes():
    """A range gives the same answers however few entries it works on at a time."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)

    def told(f, group, widths, most):
        out = {}
        for chunk, blob in zip(*(c.to_pylist() for c in f(group, most).columns), strict=True):
            out.setdefault(chunk, []).append(np.stack(S._split([blob], widths)[0]))
        return {k: np.concatenate(v, axis=1).tolist() for k, v in out.items()}

    probes, places = [], []
    for _ in range(7):
        key = np.unique(r.integers(0, 3000, 400).astype(np.uint64)) << np.uint64(4)
        probes.append(S._packed([key | r.integers(0, 3, len(key)).astype(np.uint64) | r.integers(1, 3, len(key)).astype(np.uint64) << np.uint64(2)], S._PROBE))
        a = np.sort(r.integers(0, 200, 300).astype(np.uint64) * np.uint64(2**55 + 12345))
        places.append(S._packed([a, a % np.uint64(7), r.integers(-50, 50, 300).astype(np.int64), r.integers(0, 50, 300)], S._PLACE))
    for f, blobs, sent, answered in ((S._which_hit, probes, S._PROBE, S._PROBE), (S._which_later, places, S._PLACE, S._LATER)):
        group = pa.table({"chunk": pa.array(range(10, 17), pa.int64()), "blob": pa.array(blobs, pa.binary())})
        whole = told(f, group, answered, 1 << 22)
        assert whole and sum(len(x[0]) for x in whole.values()) > 100
        for most in (1000, 300, 37):
            assert told(f, group, answered, most) == whole


def test_ids_that_are_no_numbers(spark):
    with pytest.raises(TypeError, match="whole number"):
        S.removal_digests(spark.createDataFrame([("a-1", "x")], "doc_id string, text string"))


def test_hot_id(spark):
    """Rows that share one id are dealt by their texts as well."""
    df = spark.createDataFrame([(5, f"{i} " * 30) for i in range(40)], "doc_id long, text string")
    assert [(r.n_words, r.n_removed) for r in S.removal_digests(df, chunks=9).collect()] == [(30, 29)] * 40


def test_empty(spark, empty):
    assert S.removal_digests(empty).count() == 0
