import itertools
import math
import os
import random
import subprocess
import sys
import time
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import pieces as P

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def encoded(texts, keys=None, best=False):
    v = P.load()
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    keys = P.mixed(np.arange(len(texts), dtype=np.uint64) + np.uint64(77)) if keys is None else keys
    ids, off = P.encode_block(v, raw, at, keys, best)
    back, back_at = P.decode_block(v, ids, off)
    assert np.array_equal(back, raw) and np.array_equal(back_at, at)
    return [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]


def paths(word):
    """All segmentations of a word with their weights."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    weight = {model.id_to_piece(int(i)): (int(i), x) for _, ids, ws, _ in P.load().by_length.values() for i, x in zip(ids, ws, strict=True)}
    out = {}
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        seg = [word[a:b] for a, b in itertools.pairwise(edges)]
        if all(s in weight for s in seg):
            out[tuple(weight[s][0] for s in seg)] = math.prod(weight[s][1] for s in seg)
    return out


def test_distribution_is_that_of_all_paths():
    every = paths("▁there")
    total, n = sum(every.values()), 30000
    drawn = Counter(map(tuple, encoded(["there"] * n)))
    assert set(drawn) <= set(every)
    assert max(abs(drawn[k] / n - w / total) for k, w in every.items()) < 0.012
    assert tuple(encoded(["there"], best=True)[0]) == max(every, key=every.get)


def test_looking_up(monkeypatch):
    monkeypatch.setattr(P, "_SLOTS", 8)
    r = np.random.default_rng(5)
    keys = np.unique(r.integers(0, 2**63, 900).astype(np.uint64))
    asked = np.concatenate([keys[::3], r.integers(0, 2**63, 500).astype(np.uint64), keys[:1], keys[-1:]])
    which, at = P._look_up(asked, keys, P._index(keys))
    where = {int(k): i for i, k in enumerate(keys)}
    assert which.tolist() == [i for i, h in enumerate(asked.tolist()) if h in where] and at.tolist() == [where[h] for h in asked.tolist() if h in where]


def test_draws_depend_on_the_key_alone():
    a = encoded(["one two three", "four"], np.array([5, 6], np.uint64))
    b = encoded(["four", "", "one two three"], np.array([6, 1, 5], np.uint64))
    assert a == [b[2], b[0]]
    assert len({tuple(x) for x in encoded(["reproducible segmentation"] * 50)}) > 1


def test_long_word():
    assert encoded(["ab" * 700, "x" * 49, "y" * 48]) and encoded(["ab" * 100], best=True)


def long_texts():
    r = random.Random(6)
    cjk = "".join(chr(r.choice((r.randint(0x4E00, 0x9FA5), r.randint(0x3041, 0x3096), 0x3002))) for _ in range(4000))
    blob = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(3000))
    words = " ".join(r.choice(("the", "lattice", "▁", "naïve", "日本", "  ", "😀")) for _ in range(900))
    return {"cjk": cjk, "blob": blob, "words": words, "same": "a" * 2500, "mixed": f"{blob} {cjk}{blob[:700]}  {words}", "spaces": " " * 3000, "unknown": "\U0001F9FF" * 300 + "𐎀" * 300}


@pytest.mark.parametrize("form", long_texts())
@pytest.mark.parametrize("best", [False, True])
def test_parts_give_the_pieces_of_the_whole(form, best):
    """However a text is cut into parts, the draws are the same; only shares rounded to 24 bits may tip a draw."""
    text, key = long_texts()[form], np.array([9], np.uint64)
    v, raw = P.load(), np.frombuffer(text.encode(), np.uint8)
    whole = encoded([text], key, best)[0]
    for part in (64, 333, 1 << 18):
        ids = P.encode_long(v, raw, key[0], best, part)
        assert P.decode_long(v, ids) == raw.tobytes()
        if best:  # of equally likely ones any
            weight = {int(i): math.log(x) for _, ids_, ws, _ in v.by_length.values() for i, x in zip(ids_, ws, strict=True)}
            likely = lambda found: sum(weight.get(i, 0.0) for i in found)
            assert math.isclose(likely(ids.tolist()), likely(whole), rel_tol=1e-9)
        else:
            same = sum(a == b for a, b in zip(whole, ids.tolist(), strict=False))
            assert ids.tolist() == whole or same > 0.2 * len(whole)


def test_chained_distribution():
    """One lattice over parts of three characters draws as the whole word does."""
    v, points = P.load(), np.array([ord(c) for c in "▁there"], np.uint32)
    every = paths("▁there")
    total, n = sum(every.values()), 5000
    keys = P.mixed(np.arange(n, dtype=np.uint64) + np.uint64(5))
    drawn = Counter(tuple(P._chained(v, points, [0, 3, 6], keys[i : i + 1], False)[0].tolist()) for i in range(n))
    assert set(drawn) <= set(every) and max(abs(drawn[k] / n - w / total) for k, w in every.items()) < 0.03


def test_unbroken_text_is_quick():
    r = random.Random(7)
    text = "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(80000))
    encoded([text[:1000]])
    began = time.process_time()
    encoded([text])
    assert time.process_time() - began < 0.4


def test_five_megabytes_without_a_blank_stay_below_a_gigabyte():
    code = "import random, resource, numpy as np; from scriptorium.llm import pieces as P; r = random.Random(1); t = (''.join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(1500000)) + 'a1B' * 170000).encode(); ids = P.encode_long(P.load(), np.frombuffer(t, np.uint8), np.uint64(3)); assert P.decode_long(P.load(), ids) == t and len(t) > 5e6; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout) < 1_000_000


def test_text_keys_and_long_rows(spark):
    rows = [("a-1", "there " * 50), ("a-2", "there " * 50), (None, "x"), ("a-1", None), ("a-3", "日本語" * 150000 + "ab" * 9000)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    found = P.encode(df)
    got = {(r.doc_id, len(r.ids)): r for r in found.collect()}
    assert all(r.lossless for r in got.values()) and len(got) == 5
    assert Counter((r.doc_id, r.text) for r in P.decode(found).collect()) == Counter((a, b or "") for a, b in rows)


def test_round_trip(spark, edge, empty):
    found = P.encode(edge)
    rows = found.toPandas()
    assert rows.lossless.all() and len(rows) == edge.count()
    want = Counter((r.doc_id, r.text or "") for r in edge.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.text) for r in P.decode(found).collect()) == want
    kept = P.encode(edge, keep=True)
    assert set(kept.columns) == set(edge.columns) | {"ids", "lossless"}
    assert kept.schema["lossless"].dataType.typeName() == "boolean" and kept.where("not lossless").count() == 0
    assert P.encode(empty).count() == 0
