import re
from collections import Counter

import xxhash

from scriptorium.llm import components, simhash as S


def by_hand(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def classes(values, linked):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def test_against_brute_force(spark, edge, empty):
    docs = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    prints = {t: by_hand(t) for _, t in docs}
    group = classes(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, t in docs:
        if i is not None:
            g = group[prints[t]]
            least[g] = min(i, least.get(g, i))
    want = Counter((i, f"{prints[t]:016x}", least.get(group[prints[t]])) for i, t in docs)
    assert Counter(tuple(r) for r in S.near_duplicates(edge).collect()) == want
    kept = S.one_of_each(edge)
    assert kept.columns == edge.columns and kept.count() == len(set(group.values()))
    assert S.near_duplicates(empty).count() == 0 and S.one_of_each(empty).count() == 0


def test_links_in_every_plan(spark):
    import random

    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(30)]
    values = set(base)
    for b in base:
        for _ in range(12 if b != base[0] else 200):  # one crowd
            v = b
            for _ in range(r.randint(1, 6)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v), signed(v)) for v in values], "fp long, grp long")
    want = {tuple(sorted((signed(a), signed(b)), reverse=True)) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4}
    for n in (1000, 10**10):
        got = [(x.a, x.b) for x in S._links(df, n).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert S.plan(n) == S.PLANS[n > 10**6]
        deeper = [(x.a, x.b) for x in S._links(df, n, most=3).collect()]
        assert len(deeper) == len(set(deeper)) and set(deeper) == want
    assert {r.fp for r in S._crowded(df, len(values)).collect()} and S._crowded(df, 10**10).count() == 0
    root = {x.fp: x.root for x in S.components(df.select("fp")).collect()}
    group = classes(sorted(values), lambda a, b: (a ^ b).bit_count() <= 4)
    for a in values:
        for b in values:
            same = root.get(signed(a), signed(a)) == root.get(signed(b), signed(b))
            assert same == (group[a] == group[b])


def test_components(spark):
    import random

    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(250)] + [(5, 5), (7, 6), (6, 7)]
    got = {x.node: x.root for x in components.connect(spark.createDataFrame(links, "a long, b long")).collect()}
    pairs = {frozenset(x) for x in links if x[0] != x[1]}
    nodes = sorted({v for p in pairs for v in p})
    assert got == classes(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert components.connect(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_are_settled_without_rounds(spark):
    import random

    r = random.Random(8)
    links = [(i + 1, i) for i in range(-300, 0)] + [(r.randrange(10**6), r.randrange(10**6, 10**6 + 900)) for _ in range(1500)] + [(9, 9), (-(1 << 63), (1 << 63) - 1)]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    pairs = {frozenset(x) for x in links}
    parent = {v: v for p in pairs if len(p) > 1 for v in p}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    want = sorted((v, root(v)) for v in parent)
    jobs = spark.sparkContext._jsc.sc().dagScheduler()
    begun = jobs.numTotalJobs()
    got = components.connect(df)
    assert jobs.numTotalJobs() - begun <= 8
    assert sorted((x.node, x.root) for x in got.collect()) == want
    assert sorted((x.node, x.root) for x in components.connect(df, most_in_one=0).collect()) == want
    assert sorted((x.node, x.root) for x in components.connect(df, most_in_one=1000).collect()) == want
