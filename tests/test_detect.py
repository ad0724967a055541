import json

from pyspark.sql import functions as F

from scriptorium.jobs import build_packs, error_rates, languages
from scriptorium.operators import detect, ocr, text as T
from scriptorium.sources import packs


def drawn(spark, rows):
    df = spark.createDataFrame(rows, "image_id long, text string, hint string")
    return ocr.draw_terminal(df).join(df.select("image_id", "hint"), "image_id")


def test_sources(spark):
    images = drawn(spark, [(1, "HELLO", None), (2, "HELLO", "hello"), (3, "", "привет"), (4, "HELLO", "12 !"), (5, "", " ")])
    got = {r.image_id: (r.text, r.ocr_text, r.identification_source, r.fallback_used, [x.code for x in r.languages]) for r in detect.detect_images(images, [ocr.latin_pack()], "hint", route_by_hint=False).collect()}
    assert got == {1: ("HELLO", "HELLO", "ocr", False, ["en"]), 2: ("HELLO", "HELLO", "hybrid", False, ["en"]), 3: ("привет", "", "unicode", True, ["ru"]), 4: ("HELLO", "HELLO", "ocr", False, ["en"]), 5: ("", "", "ocr", False, [])}


def test_drawn_and_circle(spark):
    images = drawn(spark, [(1, "HELLO", "HELLO"), (2, "", "HELLO"), (3, "X", "漢字")])
    results = detect.detect_drawn(images, [ocr.latin_pack()], "hint")
    got = {r.image_id: (r.text, r.ocr_text, r.identification_source, r.fallback_used) for r in results.collect()}
    assert got == {1: ("HELLO", "HELLO", "ocr", False), 2: ("HELLO", "", "ocr", True), 3: ("漢字", "X", "unicode", True)}
    expected = spark.createDataFrame([(1, "en", "Hello"), (2, "en", "HELLO"), (3, "ru", "漢字")], "image_id long, lang string, sample_text string")
    assert {r.image_id: r.ok for r in detect.circle(results, expected, strict=True).collect()} == {1: True, 2: False, 3: False}
    assert {r.image_id: r.ok for r in detect.circle(results, expected).collect()} == {1: True, 2: True, 3: False}
    report = {r.lang: (r.errors, r.chars, r.passed) for r in detect.corpus_report(results, expected).collect()}
    assert report["en"] == (5, 10, False)  # the one that was not recognised counts


def test_jobs(spark, tmp_path, capsys):
    languages.main(["list", "--json", "--code", "RU"])
    assert json.loads(capsys.readouterr().out)["unicode_ranges"][0] == {"start": "U+0400", "end": "U+04FF"}
    spark.createDataFrame([("привет",)], "text string").write.parquet(f"{tmp_path}/in")
    languages.main(["text", f"{tmp_path}/in", f"{tmp_path}/out"])
    assert json.loads(spark.read.text(f"{tmp_path}/out").first()[0])["languages"][0]["code"] == "ru"
    build_packs.main([f"{tmp_path}/packs", "latin"])
    packs.register(spark)
    assert spark.read.format("glyphpack").load(f"{tmp_path}/packs").select("pack_id").distinct().count() == 1
    (tmp_path / "c" / "en").mkdir(parents=True)
    (tmp_path / "c" / "en" / "corpus.txt").write_text("HELLO\nABC 123\n")
    row = error_rates.report(spark, f"{tmp_path}/c", ["en"]).first()
    assert (row.lang, row.strings, row.errors, row.passed) == ("en", 2, 0, True)


def test_live_results(spark):
    from scriptorium.streaming import live

    df = spark.createDataFrame([("abc",)], "text string")
    assert json.loads(live.results(df).first().json)["identification_source"] == "unicode"
    mix = live.language_mix(df.withColumn("ts", F.current_timestamp()), "ts").first()
    assert (mix.code, mix.letters) == ("en", 3) and T.is_blank is not None
