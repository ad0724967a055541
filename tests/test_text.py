import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import registry
from scriptorium.operators import text as T

RANKED = {
    "Hello world": [("en", 100)],
    "": [],
    "12345 !?": [],
    "नमस्ते": [("hi", 100)],
    "මෙවලම්": [("si", 100)],
    "English русский": [("en", 50), ("ru", 50)],
    "Привет हिन्दी": [("ru", 67), ("hi", 33)],
    "A а ا א α": [("ar", 20), ("en", 20), ("el", 20), ("he", 20), ("ru", 20)],
    "abcdefgж": [("en", 88), ("ru", 12)],
    "ж" * 251 + "a" * 249: [("en", 50), ("ru", 50)],
    "a" * 999 + "ж": [("en", 100), ("ru", 0)],
    "ﬁ Ａ ẞ": [("en", 100)],
    "ª º µ × ÷": [],
    "漢字 カナ 한글": [],
}
ROUTED = {"Hello": (True, True, "latin"), "café": (False, True, None), "москва": (False, True, "cyrillic"), "abcпривет": (False, True, None), "жα": (False, True, "cyrillic"), "αж": (False, True, "greek"), "१२३": (False, True, None), "漢字": (False, False, None), "  ": (False, False, None), "": (False, False, None)}


def by_hand(text):
    counts = {}
    for c in text or "":
        if unicodedata.category(c)[0] != "L":
            continue
        code = next((x[0] for x in registry.LANGUAGES for lo, hi in x[4] if lo <= ord(c) <= hi), None)
        if code is None and "LATIN" in unicodedata.name(c, ""):
            code = "en"
        if code:
            counts[code] = counts.get(code, 0) + 1
    total, names = sum(counts.values()), dict(zip(registry.CODES, registry.NAMES, strict=True))
    return sorted(((c, round(n / total * 100)) for c, n in counts.items()), key=lambda x: (-x[1], names[x[0]]))


def test_ranks(spark):
    df = spark.createDataFrame(list(enumerate(RANKED)), "i int, text string")
    got = {r.text: [(x.code, x.percent) for x in r.languages] for r in T.detect_languages(df).collect()}
    assert got == RANKED


def test_samples(spark):
    df = spark.createDataFrame([(x[0], x[5]) for x in registry.LANGUAGES], "code string, text string")
    assert all([(x.code, x.percent) for x in r.languages] == [(r.code, 100)] for r in T.detect_languages(df).collect())


def test_random_texts(spark):
    r = random.Random(7)
    points = [cp for x in registry.LANGUAGES for lo, hi in x[4] for cp in (lo, hi, (lo + hi) // 2)] + [lo for lo, _ in registry.fallback()] + [0x20, 0x30, 0x93F, 0x4E00, 0x1F600, 0x8B5, 0xC5D, 0xCDD]
    texts = ["".join(chr(r.choice(points)) for _ in range(r.randint(0, 40))) for _ in range(200)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    want = {i: by_hand(t) for i, t in enumerate(texts)}
    assert {x.i: [(y.code, y.percent) for y in x.languages] for x in T.detect_languages(df).collect()} == want
    both = df.select("i", T.profile("text")["counts"].alias("a"), T.counts_by_patterns("text").alias("b")).collect()
    assert all(x.a == x.b for x in both)
    joined = {(x.i, x.code): x.n for x in T.counts_by_join(df, ["i"]).collect()}
    assert joined == {(x.i, c): n for x in both for c, n in zip(registry.CODES, x.a, strict=True) if n}


def test_routing(spark):
    df = spark.createDataFrame([(t,) for t in ROUTED], "text string").withColumn("p", T.profile("text"))
    assert {r.text: (r.p.ascii_ocr, r.p.native_ocr, r.p.pack_id) for r in df.collect()} == ROUTED


def test_lines_override(spark):
    df = spark.createDataFrame([("abc", ["жжж", "  "]), ("abc", []), ("abc", [" "])], "text string, lines array<string>")
    assert [[x.code for x in r.languages] for r in T.detect_lines(df, "lines").collect()] == [["ru"], ["en"], []]


@pytest.mark.parametrize(("text", "want"), [("  “a”  ", '"a"'), ("‘x’", "'x'"), ("«y»\t", '"y"')])
def test_quotes(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.normal_quotes("t")).first()[0] == want


def test_folding_and_characters(spark):
    df = spark.createDataFrame([("Straße é Σς",)], "t string")
    assert df.select(T.folded("t")).first()[0] == "strasse" + "é" + "σσ"
    cps = [0, 0x41, 0x44F, 0x1F600]
    got = spark.createDataFrame([(c,) for c in cps], "c int").select(T.character("c"), T.u_plus("c")).collect()
    assert [tuple(r) for r in got] == [("", "U+0000"), ("A", "U+0041"), ("я", "U+044F"), ("😀", "U+1F600")]


def test_error_rate(spark):
    df = spark.createDataFrame([("a", "नमस्ते😀", "नमत😁"), ("a", "xyz", "xyz"), ("b", "", "")], "g string, e string, o string")
    got = {r.g: (r.errors, r.chars, r.failures, r.cer) for r in T.error_rate(df, ["g"], "e", "o").collect()}
    assert got == {"a": (4, 10, 1, 0.4), "b": (0, 0, 0, 0.0)}


def test_streaming(spark, tmp_path):
    from scriptorium.streaming import live

    spark.createDataFrame([(1, "привет abc"), (2, "")], "id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    q = live.languages(stream).writeStream.format("memory").queryName("live_languages").start()
    q.processAllAvailable()
    q.stop()
    assert {r.id: [x.code for x in r.languages] for r in spark.table("live_languages").collect()} == {1: ["ru", "en"], 2: []}


def test_summary(spark):
    row = T.profile
    assert row is not None and registry.languages(spark).count() == 21 and registry.ranges(spark).count() == 33
    assert registry.ranges(spark).where(F.col("start") > F.col("end")).count() == 0


def test_results_cover_every_document(spark):
    """Long and mixed texts too, each whole and with the languages found in it."""
    import json

    from scriptorium.plans import catalog
    from tests.conftest import DATA

    languages = {r.doc_id: json.loads(r.languages_json) for r in catalog.QUERIES["languages_json"](spark, DATA).collect()}
    got = {r.doc_id: json.loads(r.result_json) for r in catalog.QUERIES["result_json"](spark, DATA).collect()}
    assert set(got) == set(languages) and len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r["languages"] == languages[k] for k, r in got.items())
    assert max(len(r["languages"]) for r in got.values()) > 1
