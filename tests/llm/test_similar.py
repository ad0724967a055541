import random
import re

import numpy as np

from scriptorium.llm import similar as S, simhash as H
from tests.llm.test_simhash import classes

import corpus_pipeline


def by_hand(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def linked(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def partition(rows, sets):
    out = {}
    for r in rows:
        out.setdefault(r.root, set()).add(sets[r.doc_id])
    return {frozenset(x) for x in out.values()}


def test_against_brute_force(spark, empty):
    r = random.Random(5)
    base = [[f"b{g}w{i}" for i in range(r.randint(60, 150))] for g in range(8)]
    texts = ["", None, "  \n", "one", "ONE", "one two", "one two three four five", "one two three four five six"]
    for b in base:
        for _ in range(15):
            w = list(b)
            for k in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"x{k}{r.randrange(1000)}"
            texts.append((" " if r.random() < 0.5 else "\n").join(w))
    sets = {i: by_hand(t) for i, t in enumerate(texts)}
    values = sorted(set(sets.values()), key=sorted)
    number = {v: i for i, v in enumerate(values)}
    group = classes(range(len(values)), lambda a, b: linked(values[a], values[b]))
    want = {}
    for v, i in number.items():
        want.setdefault(group[i], set()).add(v)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert partition(S.members(docs).collect(), sets) == {frozenset(x) for x in want.values()}
    least = {}
    for i in sets:
        least.setdefault(group[number[sets[i]]], i)
    assert sorted(x.doc_id for x in S.one_of_each(docs).collect()) == sorted(least.values())
    assert S.one_of_each(empty).count() == 0


def test_the_stage_takes_near_copies_far_apart_by_simhash(spark):
    """Two words of a hundred changed: similarity 0.83, often over 4 bits of the fingerprint."""
    rows = []
    for g in range(20):
        w = [f"t{g}n{i}" for i in range(100)]
        rows += [(2 * g, " ".join(w))]
        w[30], w[70] = "other", "words"
        rows += [(2 * g + 1, " ".join(w))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(x.doc_id for x in kept.collect()) == list(range(0, 40, 2))


def test_edge_rows(spark, edge):
    kept = S.one_of_each(edge)
    values = sorted({by_hand(x.text) for x in edge.select("text").collect()}, key=sorted)
    group = classes(range(len(values)), lambda a, b: linked(values[a], values[b]))
    assert kept.columns == edge.columns and kept.count() == len(set(group.values()))


def test_the_index_of_fingerprints_finds_all_pairs_within_its_radius(spark):
    r = random.Random(6)
    values = {r.getrandbits(64) for _ in range(8)}
    for b in list(values):
        for _ in range(10):
            v = b
            for _ in range(r.randint(1, 10)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    prints = [(k, v) for k, v in enumerate([*values, *list(values)[:5]])]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(k, signed(v), k // 2) for k, v in prints], "key long, fp long, grp long")
    want = {(a, b) for a, v in prints for b, w in prints if a > b and a // 2 != b // 2 and (v ^ w).bit_count() <= H.WIDE}
    for n, plan in zip((1000, 10**8, 10**12), H.WIDE_PLANS, strict=True):
        assert H.plan(n, H.WIDE) == plan and sum(bits for bits, _ in plan) == 64 and sum(k + 1 for _, k in plan) > H.WIDE
        got = [(x.a, x.b) for x in H.pairs(df, n).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    deeper = [(x.a, x.b) for x in H.pairs(df, 1000, most=3).collect()]
    assert len(deeper) == len(set(deeper)) and set(deeper) == want
    assert {(x.a, x.b) for x in H.draws(df, len(prints)).collect()} == {(a, b) for a, v in prints for b, w in prints if a > b and v == w}


def test_the_stage_links_by_simhash_where_no_bucket_proposes_a_pair(spark, monkeypatch):
    r = random.Random(7)
    texts = ["", None, "one", "one two three"]
    for g in range(12):
        w = [f"t{g}n{i}" for i in range(r.randint(80, 160))]
        for k in range(9 if g else 60):  # one crowd
            copy = list(w)
            for _ in range(min(k, r.randint(0, 4))):
                copy[r.randrange(len(w))] = f"x{r.randrange(1000)}"
            texts.append(" ".join(copy))
    sets, fp = [by_hand(t) for t in texts], []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        hs = [int(h) for h in S.sets(raw, np.array([0, len(raw)]))[0]]
        fp.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)))
    near = lambda a, b: not sets[a] and not sets[b] or (fp[a] ^ fp[b]).bit_count() <= H.WIDE and linked(sets[a], sets[b])
    want = sorted(set(classes(range(len(texts)), near).values()))
    assert len(want) < len(set(sets))
    monkeypatch.setattr(S, "_open", lambda table, by, seen=None: table.where("false"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want
