import math
import random
import re
from collections import Counter

from scriptorium.llm import secrets as S


def by_hand(t):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", t or ""):
        if len(m[0]) >= 18:
            out.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", t or ""):
        if len(m[0]) >= 16:
            out.append((m.start(), 2, "hex", m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def entropy(w):
    return -sum(n / len(w) * math.log2(n / len(w)) for n in Counter(w).values())


def added_by_hand(t):
    base, out = by_hand(t), []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", t or ""):
        c = m[0]
        if len(c) < 20 or not re.search("[0-9]", c) or not re.search("[A-Za-z]", c) or re.search(S.ALLOWED, c) or any(s < m.end() and m.start() < e for _, s, e in base):
            continue
        least = S.THRESHOLDS["hexadecimal" if re.fullmatch("[0-9a-fA-F]+", c) else "base64"]
        hits = [i for i in range(len(c) - S.WINDOW + 1) if entropy(c[i : i + S.WINDOW]) >= least - 1e-9]
        if hits:
            out.append(("entropy", m.start() + hits[0], m.start() + hits[-1] + S.WINDOW))
    return out


def test_random_texts(spark):
    r = random.Random(9)
    parts = ["token", "SECRET", "api_key", "apikey", "Password", ":", "=", " ", " ", "'", '"', "é😀", "AKIA", "ABCDEFGH1234567890", "deadbeef", "0123456789abcdef", "\n", "x.y", "+/", "k7Jq9ZpX2mWc4RtYv8BnL3sD", "example", "aaaa1111"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(600)]
    texts += ["".join(r.choice("ABCDEFabcdef0123456789") for _ in range(r.randint(18, 60))) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in S.find_secrets(df).collect():
        t = texts[row.doc_id]
        assert [(s.kind, s.start, s.end) for s in row.base] == by_hand(t), t
        assert [(s.kind, s.start, s.end) for s in row.added] == added_by_hand(t), t


def test_tables(spark, edge, empty):
    rows = S.find_secrets(edge).collect()
    assert len(rows) == edge.count() and S.find_secrets(empty).count() == 0
    text = {r.doc_id: r.text for r in edge.where("doc_id > 300").collect()}
    assert all([(s.kind, s.start, s.end) for s in r.base] == by_hand(text[r.doc_id]) for r in rows if r.doc_id in text)
    long = spark.createDataFrame([(1, "k7Jq9ZpX2mWc4RtYv8BnL3sD" * 400), (2, "token" + " " * 50000), (3, "f" * 100000)], "doc_id long, text string")
    found = {r.doc_id: r for r in S.find_secrets(long).collect()}
    assert len(found[1].added) == 1 and found[2].base == [] and found[3].base[0].end == 100000


def test_no_python_in_the_plan(spark, edge):
    plan = S.find_secrets(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hexadecimal_keys_behind_a_prefix(spark):
    """Upper-case keys are found behind a name as they are bare; a number behind a name is no key."""
    r = random.Random(2)
    keys = ["".join(r.choice("0123456789ABCDEF") for _ in range(32)) for _ in range(150)]
    keys = [k for k in keys if all(entropy(k[i : i + 20]) >= 3 and re.search("[A-F]", k[i : i + 20]) for i in range(13)) and not re.search("[0-9]{16}", k)]
    texts = [f"set {p}{k} now" for k in keys for p in ("", "SESSION=", "sha1=", "id/")]
    texts += ["order=20231115123456789012", "sha1=AAAAAAAAAAAAAAAAAAA1AAAAAAAAAAAA"]
    assert len(keys) > 100
    for row in S.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        if row.doc_id < 4 * len(keys):
            key = keys[row.doc_id // 4]
            assert len(row.added) == 1 and key in texts[row.doc_id][row.added[0].start : row.added[0].end], texts[row.doc_id]
        else:
            assert row.added == [], texts[row.doc_id]


def test_many_matches_take_linear_time(spark):
    """Lists of checksums: twice the matches take about twice as long."""
    import time

    def took(n, form):
        text = "".join(form.format(f"{i * 0x9E3779B97F4A7C15 % 2**128:032x}") for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            row = S.find_secrets(df).first()
            best = min(best, time.perf_counter() - began)
        assert len(row.base) + len(row.added) >= n
        return best

    for form in ("{}  file\n", "k{}Q\n"):
        took(4000, form)
        assert took(16000, form) < 2.2 * took(8000, form) + 0.2


def test_blocks_of_matches(spark):
    """More matches than a block holds, of all kinds and overlapping, against brute force."""
    r = random.Random(4)
    parts = ["token=abcdefabcdef0123 ", "AKIA" + "B" * 16, "0123456789abcdef", "k7Jq9ZpX2mWc4RtYv8BnL3sD", " ", "\n", "x", "=", "é"]
    texts = ["".join(r.choice(parts) for _ in range(3000)) for _ in range(3)]
    for row in S.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert [(s.kind, s.start, s.end) for s in row.base] == by_hand(texts[row.doc_id])
        assert [(s.kind, s.start, s.end) for s in row.added] == added_by_hand(texts[row.doc_id])
