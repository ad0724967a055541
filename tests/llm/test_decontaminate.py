import hashlib
import re
from collections import Counter

import pytest

from scriptorium.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def by_hand(text, items):
    ws, hit, met = words(text), set(), set()
    for item, body in items:
        iw = words(body)
        n = min(10, len(iw))
        if not n:
            continue
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(ws) - n + 1):
            if tuple(ws[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                if item is not None:
                    met.add(str(item))
    return len(ws), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def items():
    long = " ".join(f"W{i}" for i in range(5, 25))
    return [(1, long), (2, "the of"), (3, None), (4, "  "), (5, "é"), (None, "and to"), (6, "w9 " * 12), (1, "der die und"), (10, long), (7, "текст")]


@pytest.mark.parametrize("limit", [D.INDEX_BYTES, 0])
def test_against_brute_force(spark, edge, items, limit):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    got = D.find_contamination(edge, bench, index_bytes=limit).collect()
    want = Counter((r.doc_id, *by_hand(r.text, items)) for r in edge.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    for r in got:
        assert sum(x.end - x.start for x in r.hit_runs) == r.n_hit


def test_removal(spark, edge, empty, items):
    bench = spark.createDataFrame(items[:1], "item_id long, text string")
    kept = D.remove_contaminated(edge, bench)
    assert kept.columns == edge.columns
    want = Counter(r.doc_id for r in edge.collect() if not by_hand(r.text, items[:1])[4])
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert D.remove_contaminated(edge, bench.limit(0)).count() == edge.count()
    assert D.remove_contaminated(empty, bench).count() == 0 and D.find_contamination(empty, bench).count() == 0


@pytest.mark.parametrize("limit", [D.INDEX_BYTES, 0])
@pytest.mark.parametrize("share", [0.0, 0.5])
def test_removal_judges_each_row(spark, limit, share):
    """Rows that share an id with a contaminated row, or have none like it, stay on both sides of the switch."""
    leak = " ".join(f"w{i}" for i in range(12))
    rows = [(1, leak), (1, "clean"), (None, leak), (None, "clean too"), (None, None), (2, ""), (3, f"{leak} {'x ' * 20}"), (3, leak), (4, "clean"), (4, "clean")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, gone long")
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    kept = D.remove_contaminated(docs, bench, max_share=share, index_bytes=limit)
    assert kept.columns == docs.columns
    assert sorted(r.gone for r in kept.collect()) == [1, 3, 4, 5] + [6] * (share == 0.5) + [8, 9]


@pytest.mark.parametrize("limit", [D.INDEX_BYTES, 0])
def test_ids_of_any_type(spark, limit):
    leak = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([("a-1", leak, "k"), ("a-1", "clean", "k"), (None, leak, "k"), (None, "x", "k")], "doc_id string, text string, `key` string")
    bench = spark.createDataFrame([("b/1", leak), ("b/2", leak), (None, "short one")], "item_id string, text string")
    got = {(r.doc_id, r.n_words): r for r in D.find_contamination(docs, bench, index_bytes=limit).collect()}
    assert got["a-1", 12].items == ["b/1", "b/2"] and got[None, 12].n_hit == 12 and not got["a-1", 1].contaminated
    assert sorted(r.text for r in D.remove_contaminated(docs, bench, index_bytes=limit).collect()) == ["clean", "x"]


def test_many_copies_and_a_common_item(spark):
    """Copies of a leaking text and a window that many items share cost one row each on the joining path."""
    leak = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(i, f"{leak} x" if i % 3 == 0 else f"d{i} " * 20) for i in range(300)], "doc_id long, text string").repartition(7)
    bench = spark.createDataFrame([(i, f"{leak} y{i}") for i in range(50)], "item_id long, text string")
    small, large = (sorted(map(tuple, D.find_contamination(docs, bench, index_bytes=n).collect())) for n in (D.INDEX_BYTES, 0))
    assert small == large and sum(r[2] == 15 and r[3] == 50 for r in small) == 100


def test_index_is_bounded():
    import pickle

    items = [(i, " ".join(f"word{(i * 7 + j * j) % 5003}" for j in range(200))) for i in range(700)]
    size = sum(len(t) + D.ROW_BYTES for _, t in items)
    assert len(pickle.dumps(D.Index(items))) < 8 * size
    empty = [(i, None) for i in range(1000)]
    assert len(pickle.dumps(D.Index(empty))) < D.ROW_BYTES * 1000
