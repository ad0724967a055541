import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import langid as L, quality as Q
from tests.conftest import DATA


def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_languages_of_held_out_documents(spark):
    d = docs(spark)
    model = L.train(d)
    found = L.classify(d, model).join(d.select("doc_id", "lang"), "doc_id").withColumn("held", L.held_out("doc_id"))
    right = found.where("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    assert found.where("score < 0 or score > 1").count() == 0
    swapped = d.withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "doc_id": F.col("doc_id") + 7})
    again = L.classify(swapped, model).select((F.col("doc_id") - 7).alias("doc_id"), "lang_pred", "score")
    assert again.exceptAll(L.classify(d, model)).count() == 0  # the text alone decides


def test_samples_are_packed_for_the_driver(spark):
    """22 MB of places and counts went through the driver's JVM at most; packed, they are under half of that."""
    raw, packed = 0, 0
    for (t,) in docs(spark).select("text").where("text IS NOT NULL").limit(200).collect():
        text = np.frombuffer(t.encode(), np.uint8)
        (c,) = L._counts(text, np.array([0, len(text)]))
        at, n = np.flatnonzero(c).astype(np.int32), c[c > 0].astype(np.float32)
        held = L._packed(at, n)
        back = L._unpacked(held)
        assert all(x.dtype == y.dtype and (x == y).all() and len(x) == len(y) for x, y in zip(back, (at, n), strict=True))
        raw, packed = raw + at.nbytes + n.nbytes, packed + len(held)
    assert 2 * packed < raw
    assert [len(x) for x in L._unpacked(L._packed(np.zeros(0, np.int32), np.zeros(0, np.float32)))] == [0, 0]


def test_hierarchy():
    texts = {"en": "the cat and the dog", "de": "der hund und die katze", "fr": "le chat et les chiens", "es": "el gato y los perros", "ru": "кошка и собака"}
    sparse, langs = [], []
    for code, t in texts.items():
        for i in range(3):
            raw = np.frombuffer(f"{t} {t[: 5 + i]}".encode(), np.uint8)
            (c,) = L._counts(raw, np.array([0, len(raw)]))
            sparse.append((np.flatnonzero(c).astype(np.int32), c[c > 0]))
            langs.append(code)
    model = L.Model(sparse, langs)
    assert model.of == {"germanic": ["de", "en"], "romance": ["es", "fr"], "slavic": ["ru"]}
    said = [*texts.values(), "", "12 3!", "É"]
    raw = np.frombuffer("".join(said).encode(), np.uint8)
    names, score = model.predict(raw, np.concatenate([[0], np.cumsum([len(s.encode()) for s in said])]))
    assert names[:5] == list(texts) and names[5:7] == ["und", "und"] and names[7] in texts and score[5] == 0


def test_language_tables(spark, edge, empty):
    kept = L.with_language(edge)
    assert kept.columns == edge.columns
    gone = {r.text for r in edge.collect()} - {r.text for r in kept.collect()}
    assert {None, "", "  \n\t", "7 8 9", "▁ ▁", "\x00\x01"} <= gone
    assert L.train(empty) is None and L.with_language(empty).count() == 0
    und = L.classify(edge, None).collect()
    assert {r.lang_pred for r in und} == {"und"} and len(und) == edge.count()


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    found = Q.score(docs(spark), labels)
    held = found.where("held_out").join(labels, "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.85
    assert found.where("score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0


def test_rules_as_columns_give_what_the_rules_give(spark):
    r = np.random.default_rng(1)
    x = r.random((400, len(Q.STATISTICS)))
    y = ((x[:, 3] > 0.4) & (x[:, 5] < 0.8) | (r.random(400) < 0.05)).astype(float)
    b, rules = Q.fit(x, y)
    assert 0 < len(rules) < 120
    want = 1 / (1 + np.exp(-(b + Q.fires([rule for _, rule in rules], x) @ np.array([w for w, _ in rules]))))
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], [f"s_{c}" for c in Q.STATISTICS])
    got = np.array([row[0] for row in df.select(Q.compiled((b, rules))).collect()])
    assert np.allclose(got, want) and ((want > 0.5) == (y > 0.5)).mean() > 0.9


def test_statistics():
    said = "AB cd! cd!\ncd! 12"
    raw = np.frombuffer(said.encode(), np.uint8)
    (row,) = Q.statistics(raw, np.array([0, len(raw)]))
    s = dict(zip(Q.STATISTICS, row, strict=True))
    assert (s["words"], s["lines"], s["distinct"], s["top_word"]) == (5, 2, 0.6, 0.6)
    assert s["bangs"] == 3 / len(raw) and s["same_next"] == 0.4


def test_quality_tables(spark, edge, empty):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, score string")
    assert Q.score(edge, labels).count() == edge.count()
    assert Q.score(empty, labels).count() == 0
    assert {r.score for r in Q.score(edge, labels.limit(0)).collect()} == {0.5}


def grams_by_hand(text):
    """Of each order the n-grams of a text's cleaned bytes, one at a time."""
    out, low = [], []
    raw = (text or "").encode()
    for i, b in enumerate(raw):
        if not (b >= 128 or 65 <= b <= 90 or 97 <= b <= 122):
            b = 32
        elif 65 <= b <= 90 or b >= 128 and i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97:
            b += 32
        if b != 32 or not low or low[-1] != 32:
            low.append(b)
    for n in L.ORDERS:
        for i in range(len(low) - n + 1):
            value = 0
            for b in low[i : i + n]:
                value = (value * 257 + b) % 2**32
            out.append(((value + n * 7919) * 2654435761 % 2**32) >> 18)
    return out


def language_by_hand(model, text):
    if not any(c.isalpha() for c in text or ""):
        return L.UNKNOWN, 0.0
    codes = grams_by_hand(text)
    margin = [sum(float(w[c]) for c in codes) / max(len(codes), 1) for w in model.weights]
    p = [1 / (1 + np.exp(-np.clip(a * m + b, -30, 30))) for (a, b), m in zip(model.logistics, margin, strict=True)]
    family = {f: p[model.index[f]] if f in model.index else 1 - p[model.index[model.families[0]]] for f in model.families} if len(model.families) > 1 else {model.families[0]: 1.0}
    best = max(model.families, key=lambda f: family[f])
    duel = lambda a, b: p[model.index[a, b]] if (a, b) in model.index else 1 - p[model.index[b, a]]
    rank = {a: (sum(duel(a, b) > 0.5 for b in model.of[best] if b != a), sum(duel(a, b) for b in model.of[best] if b != a)) for a in model.of[best]}
    name = max(model.of[best], key=lambda a: rank[a])
    return name, float(family[best] * min([1.0, *(duel(name, b) for b in model.of[best] if b != name)]))


def test_languages_by_hand(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    model = L.train(d)
    said = [(r.doc_id, r.text) for r in d.collect()] + [(10**6 + i, t) for i, t in enumerate((None, "", "7 8", "É", "ß×÷", "Straße ÄÖÜ", "日本語", "a", "der the le el " * 3))]
    found = {r.doc_id: r for r in L.classify(spark.createDataFrame(said, "doc_id long, text string"), model).collect()}
    for key, text in said:
        name, score = language_by_hand(model, text)
        assert found[key].lang_pred == name and abs(found[key].score - score) < 1e-6, (key, text)


def test_the_sample_is_bounded(spark):
    """One repeated id holds a third of all rows: at most so many different rows of each language are learned from."""
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    some = spark.createDataFrame([(5, f"the cat number {i % 3}", "en") for i in range(300)], "doc_id long, text string, lang string")
    assert L.train(d.union(some), per_language=10) is not None
    labels = spark.createDataFrame([(1, i % 2) for i in range(500)] + [(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert Q.score(d.union(some), labels).count() == d.count() + 300


def statistics_by_hand(text):
    raw = (text or "").encode()
    size, words, lines = max(len(raw), 1), [w for w in re.split(rb"[ \t-\r]+", raw) if w], [x for x in raw.split(b"\n") if x]
    per, n_lines = max(len(words), 1), max(len(lines), 1)
    share = lambda test: sum(map(test, raw)) / size
    kind = lambda b: 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b in b" \t\n\x0b\x0c\r" else 5 if b >= 128 else 6 if b in b".,;:'\"-()?" else 7 if b == 33 else 8 if b == 124 else 0
    return [
        len(raw), len(words), *(share(lambda b, k=k: kind(b) == k) for k in range(1, 9)), share(lambda b: kind(b) == 0), sum(map(len, words)) / per, sum(len(w) > 12 for w in words) / per, len(set(words)) / per,
        max(Counter(words).values(), default=0) / per, sum(a == b for a, b in zip(words, words[1:], strict=False)) / per, len(lines), len(words) / n_lines, len(set(lines)) / n_lines, sum(kind(w[-1]) in (0, 7, 8) for w in words) / per,
    ]


def test_quality_by_hand(spark):
    """Every statistic of every row, and the score from the rules, one row at a time."""
    d, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    said = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()] + [(10**6 + i, t) for i, t in enumerate((None, "", " \n", "!!! | x\n\nx x", "é" * 40))]
    rows = spark.createDataFrame(said, "doc_id long, text string")
    stats = Q.with_statistics(rows).cache()
    b, rules = Q.train(stats, labels)
    scored = {r.doc_id: r.score for r in stats.select("doc_id", Q.compiled((b, rules)).alias("score")).collect()}
    found = {r.doc_id: [r[f"s_{c}"] for c in Q.STATISTICS] for r in stats.collect()}
    for key, text in said:
        own = statistics_by_hand(text)
        assert np.allclose(found[key], own, rtol=1e-12, atol=1e-12), (key, text)
        total = b + sum(w for w, rule in rules if all((found[key][j] > cut) == above for j, above, cut in rule))
        assert abs(scored[key] - 1 / (1 + np.exp(-total))) < 1e-9
