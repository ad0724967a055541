import numpy as np
import pytest

from scriptorium.functions import font, pixels as P, registry
from scriptorium.operators import matching as M, ocr
from scriptorium.sources import images, packs


@pytest.fixture(scope="module")
def latin():
    return ocr.latin_pack()


@pytest.mark.parametrize("text", ["HELLO WORLD", "ABC 123", "THE QUICK BROWN FOX", "0O8B S5", "X"])
def test_round_trip(latin, text):
    assert ocr.spelt(ocr.Recogniser([latin]).page(font.drawn(text))) == text


def test_inverted_and_blank(latin):
    r = ocr.Recogniser([latin])
    assert ocr.spelt(r.page(255 - font.drawn("INK"))) == "INK"
    assert r.page(np.full((40, 80), 255, np.uint8)) == []


def test_noise_goes_through_the_local_threshold():
    a = font.drawn("AB").astype(float) * 0.5 + 60
    ink = P.binarised(np.clip(a + np.random.default_rng(0).normal(0, 4, a.shape), 0, 255).astype(np.uint8))
    assert len(P.page_lines(ink)) == 1


def test_components():
    a = np.array([[1, 0, 1, 1], [1, 0, 0, 1], [0, 1, 0, 1], [1, 1, 1, 1]], bool)
    assert sorted(P.components(a)) == [(0, 0, 1, 2, 2), (0, 0, 4, 4, 9)]


def test_features():
    ring = np.ones((9, 9), bool)
    ring[3:6, 3:6] = False
    assert P.holes(ring) == 1 and P.holes(np.ones((3, 3), bool)) == 0
    assert P.features(np.zeros((4, 4), bool)) == (0, 0, 0, 1.0)


def test_otsu_and_blur():
    h = np.zeros(256, int)
    h[10], h[200] = 5, 5
    assert P.otsu_threshold(h) == 10 and P.otsu_threshold(np.eye(256, dtype=int)[7]) == 128
    a = np.arange(25, dtype=np.uint8).reshape(5, 5) * 10
    assert P.blurred(a)[2, 2] == 120 and P.blurred(a).shape == a.shape


def test_rotation_and_skew():
    a = np.full((60, 200), 255, np.uint8)
    a[28:32, 20:180] = 0
    turned = P.rotated(a, 0.1)
    y, x = np.nonzero(P.deskewed(turned) < 200)
    assert y.max() - y.min() < np.ptp(np.nonzero(turned < 200)[0])


def test_segmenters():
    ink = np.zeros((40, 300), bool)
    ink[5:8, 10:290] = True  # a headline
    for x in (20, 80, 140, 200):
        ink[8:30, x : x + 20] = True
    assert P.headline(ink)[0] <= 5 <= P.headline(ink)[1]
    assert P.segment_indic(ink)
    assert len(P.segment_arabic(ink[:, :200])) == 1
    a, b = P.cut(np.ones((20, 10), bool), 0, 0, 10, 20), P.Glyph(2, 0, 4, 4, np.ones((4, 4), bool))
    assert len(P.attach_marks([a, b])) == 1
    assert P.merged_lines([(0, 0, 5, 5), (2, 9, 9, 5), (0, 40, 5, 5)], 8) == [(0, 0, 11, 14), (0, 40, 5, 5)]


def test_ligatures_and_order(spark, latin):
    rows = [{"x": i, "y": 0, "w": 1, "h": 1, "codepoint": cp, "confidence": 0.5} for i, cp in enumerate((0x644, 0x627, 0x628))]
    assert [g["codepoint"] for g in ocr.merge_ligatures(rows)] == [0xFEFB, 0x628]
    df = spark.createDataFrame([(1, i, cp) for i, cp in enumerate((0x644, 0x644, 0x627, 0x41))], "line int, glyph_no int, codepoint int")
    assert M.ligatures(df, ["line"]).first().points == [0xFDF2, 0x627, 0x41]


def test_mixed_scripts(latin):
    other = ocr.pack("cyrillic")
    other.add(0x416, np.ones((40, 28), bool))
    r = ocr.Recogniser([latin, other.ready()])
    assert ocr.spelt(r.page(font.drawn("ABC"))) == "ABC"
    with pytest.raises(LookupError):
        r.page(font.drawn("ABC"), hint="thai")


def test_text_of_images(spark, latin):
    df = spark.createDataFrame([(1, "HELLO"), (2, ""), (3, None)], "image_id long, text string")
    got = {r.image_id: (r.ocr_text, r.glyph_count, r.error) for r in ocr.read_text(ocr.draw_terminal(df), [latin]).collect()}
    assert got == {1: ("HELLO", 5, None), 2: ("", 0, None), 3: ("", 0, None)}
    bad = spark.createDataFrame([(9, 0, 5, bytearray(b""))], "image_id long, width int, height int, pixels binary")
    assert ocr.read_text(bad, [latin]).first().error == "no image"


def test_relational_match_agrees(spark, latin):
    bits = lambda b: np.packbits(np.pad(b.ravel(), (0, -b.size % 64)), bitorder="little").view(np.int64).tolist()
    rows = [("latin", int(cp), bits(b), *map(int, s[:3]), float(s[3])) for cp, b, s in zip(latin.points, latin.bitmaps, latin.shapes, strict=True)]
    df = spark.createDataFrame(rows, "pack_id string, codepoint long, bits array<long>, holes int, endpoints int, junctions int, aspect double")
    got = M.match_prototypes(df.withColumnRenamed("codepoint", "own"), df, M.packs(spark), ["own"]).collect()
    assert all(r.own == r.codepoint for r in got) and len(got) == len(rows)


def test_pack_files(spark, latin, tmp_path):
    packs.register(spark)
    df = spark.createDataFrame(packs.rows_of(latin), packs.SCHEMA)
    df.repartition(4).write.format("glyphpack").mode("append").save(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["latin.clpk"]
    back = spark.read.format("glyphpack").load(str(tmp_path))
    assert back.exceptAll(df).count() == 0 and back.count() == df.count()
    (again,) = ocr.packs_from(back)
    assert ocr.spelt(ocr.Recogniser([again]).page(font.drawn("DATA"))) == "DATA"
    for bad, why in ((b"", "small"), (b"XXXX" + bytes(20), "not"), (b"CLPK" + bytes(20), "version"), (packs.build([r.asDict() for r in df.collect()])[:-5], "cut")):
        with pytest.raises(ValueError, match=why):
            list(packs.parse(bad))


def test_pnm(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(font.as_pgm(font.drawn("HI")))
    (tmp_path / "b.ppm").write_bytes(b"P6 # a comment\n2 1\n255\n" + bytes([255, 0, 0, 0, 0, 255]))
    (tmp_path / "c.ppm").write_bytes(b"P6\n2 2\n255\n" + bytes(5))
    got = {r.path[-5:]: r for r in images.read_pnm(spark, str(tmp_path)).collect()}
    assert list(got["b.ppm"].pixels) == [76, 29] and got["c.ppm"].error == "samples are missing"
    assert ocr.read_text(images.read_pnm(spark, str(tmp_path)).where("error is null and width > 5"), [ocr.latin_pack()]).first().ocr_text == "HI"


def test_corpora(spark, tmp_path):
    (tmp_path / "en").mkdir()
    (tmp_path / "en" / "corpus.txt").write_text(" one \n\n two\n")
    assert sorted(tuple(r) for r in images.read_corpora(spark, str(tmp_path)).collect()) == [("en", 1, "one"), ("en", 2, "two")]


def test_drawn_letters_of_an_installed_font(spark):
    if font.find_font() is None:
        pytest.skip("no font")
    hebrew = ocr.drawn_pack(spark, "hebrew")
    made, r = font.JvmFont(spark, font.find_font()), ocr.Recogniser([ocr.latin_pack(), hebrew])
    hits = sum(ocr.spelt(r.page(made.draw(chr(cp)), hint="hebrew")) == chr(cp) for cp in hebrew.points[:12])
    assert hits >= 11
    assert {p for p, *_ in registry.pack_ranges()} == {x[6] for x in registry.LANGUAGES} - {"latin"}


def test_image_files(spark, tmp_path):
    if font.find_font() is None:
        pytest.skip("no font")
    made = font.JvmFont(spark, font.find_font())
    (tmp_path / "a.png").write_bytes(made.draw_free("ABC"))
    (tmp_path / "b.bmp").write_bytes(made.draw_free("a long line of text", kind="bmp"))
    (tmp_path / "c.png").write_bytes(b"no image")
    got = {r.path[-5:]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert got["a.png"].width >= 160 and got["a.png"].error is None and got["b.bmp"].width > 200
    assert len(got["a.png"].pixels) == got["a.png"].width * got["a.png"].height and min(got["a.png"].pixels) < 50
    assert got["c.png"].error
    rows = spark.createDataFrame([(1, 1, 2, 3, bytearray([255, 0, 0, 0, 255, 0]))], "i long, w int, h int, c int, d binary")
    assert list(images.from_samples(rows, id_col="i", width="w", height="h", channels="c", data="d").first().pixels) == [76, 149]


def test_hints_and_routes(latin):
    r = ocr.Recogniser([latin])
    ink = P.binarised(font.drawn("ABC"))
    x, y, w, h = P.page_lines(ink)[0]
    assert r.route(ink[y : y + h, x : x + w]) == "latin" and r.route(ink, "greek") == "greek"
    assert r.route(np.zeros((10, 10), bool)) == "latin"
    assert ocr.Recogniser([latin], reverse_rtl=True).line(ink[y : y + h, x : x + w])[0]["codepoint"] == ord("A")
