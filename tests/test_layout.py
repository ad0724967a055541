"""Shapes, boxes, pages of several lines, files and reports against plain Python."""

import json
import random

import numpy as np
import pytest

from scriptorium.functions import font, pixels as P, registry
from scriptorium.jobs import full_circle
from scriptorium.operators import matching as M, ocr, text as T
from scriptorium.plans import catalog
from scriptorium.sources import files, images
from tests.conftest import DATA


def boxes(r, n):
    out, x = [], 0
    for _ in range(n):
        x += r.randint(-3, 18)
        out.append((max(0, x), r.randint(0, 12), r.randint(1, 14), r.randint(1, 20)))
    return out


RULES = {
    "touching": lambda p, g, gap, overlap: abs(p.y - g.y) <= max(4, (p.h + g.h) // 2 // 2) and (gap <= max(6, p.w // 4) or overlap > 0),
    "near": lambda p, g, gap, overlap: gap <= max(2, (p.w + g.w) // 2 // 8) and abs(p.y - g.y) <= (p.h + g.h) // 2 // 2 or overlap > max(1, (p.w + g.w) // 2 // 3) and abs(p.bottom - g.y) <= max(2, (p.h + g.h) // 2 // 4),
}


@pytest.mark.parametrize("rule", M.JOINS)
def test_boxes_fold_as_glyphs_do(spark, rule):
    r = random.Random(3)
    lines = {i: boxes(r, r.randint(1, 9)) for i in range(60)}
    df = spark.createDataFrame([(i, k, *b) for i, bs in lines.items() for k, b in enumerate(bs)], "line int, glyph_no int, x int, y int, w int, h int")
    got = {}
    for row in M.merged_boxes(df, ["line"], rule).orderBy("line", "box_no").collect():
        got.setdefault(row.line, []).append((row.x, row.y, row.w, row.h))
    for i, bs in lines.items():
        glyphs = [P.Glyph(x, y, w, h, np.ones((h, w), bool)) for x, y, w, h in bs]
        want = P.attach_marks(glyphs) if rule == "marks" else P.fold(glyphs, RULES[rule])
        assert got[i] == [(g.x, g.y, g.w, g.h) for g in want], (rule, bs)


def thinned_by_hand(ink):
    h, w = ink.shape
    a = [[int(v) for v in row] for row in ink]
    near = lambda a, y, x: sum(a[j][i] for j in range(max(0, y - 1), min(h, y + 2)) for i in range(max(0, x - 1), min(w, x + 2)) if (j, i) != (y, x))
    for _ in range(32):
        before = [row[:] for row in a]
        for test in (lambda n: n < 2, lambda n: n == 4):
            b = [row[:] for row in a]
            for y in range(1, h - 1):
                for x in range(1, w - 1):
                    if a[y][x] and test(near(a, y, x)):
                        b[y][x] = 0
            a = b
        if a == before:
            break
    on = [near(a, y, x) for y in range(h) for x in range(w) if a[y][x]]
    return min(255, sum(n <= 1 for n in on)), min(255, sum(n >= 3 for n in on))


def test_ends_and_forks_of_a_stack():
    r = np.random.default_rng(2)
    shapes = [r.random((12, 9)) < d for d in (0.0, 0.2, 0.5, 0.7, 0.95, 1.0) for _ in range(4)]
    assert P.ends_and_forks(np.array(shapes)) == [thinned_by_hand(s) for s in shapes]
    assert [P.features(s)[1:3] for s in shapes if s.any()] == [thinned_by_hand(s) for s in shapes if s.any()]


def test_parts_against_a_flood():
    r = np.random.default_rng(5)
    for _ in range(30):
        a = r.random((9, 11)) < 0.5
        seen, want = np.zeros_like(a), []
        for y in range(9):
            for x in range(11):
                if a[y, x] and not seen[y, x]:
                    todo, part = [(y, x)], []
                    seen[y, x] = True
                    while todo:
                        j, i = todo.pop()
                        part.append((j, i))
                        for v, u in ((j - 1, i), (j + 1, i), (j, i - 1), (j, i + 1)):
                            if 0 <= v < 9 and 0 <= u < 11 and a[v, u] and not seen[v, u]:
                                seen[v, u] = True
                                todo.append((v, u))
                    ys, xs = [p[0] for p in part], [p[1] for p in part]
                    want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part)))
        assert sorted(P.components(a)) == sorted(want)


def test_lines_joined_and_cut_again():
    """Near lines are one on a short page, and are cut again where the joined line is too tall."""
    short = P.page_lines(P.binarised(font.drawn_lines(["ABC", "DEF"], [24, 5])))
    assert [(y, h) for _, y, _, h in short] == [(16, 61)]
    tall = P.page_lines(P.binarised(font.drawn_lines(["ABC", "DEF", "GHI", "JKL", "MNO", "PQR"], [24, 5])))
    assert [(y, h) for _, y, _, h in tall] == [(16 + 28 * i + 5 * ((i + 1) // 2) + 24 * (i // 2), 28) for i in range(6)]


def test_syllables_are_cut_at_a_thin_place():
    """Two letters under one headline: one part, cut where it is thin; joined letters of Arabic stay one word."""
    ink = np.zeros((40, 260), bool)
    for x, w in ((10, 24), (60, 24), (110, 70), (200, 24)):
        ink[8:34, x : x + w] = True
    ink[:, 142:146] = False
    ink[20:24, 142:146] = True
    assert [g.x for g in P.segment(ink)] == [10, 60, 110, 200]
    ink[6:9, 5:240] = True
    found = P.segment_indic(ink)
    assert found and sum(g.w for g in found) >= 200
    assert [g.w for g in P.segment_arabic(ink)] == [235]


def test_ascii_report_by_hand(spark):
    """The registered report against an edit distance in plain Python, over the same drawn pages."""
    import re

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    got = catalog.QUERIES["ascii_error_report"](spark, DATA).first()
    reader, errors, chars = ocr.Recogniser([ocr.latin_pack()]), 0, 0
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        said = re.sub(" +", " ", re.sub(r"[^\x20-\x7E]", "", r.text)).strip(" ")
        errors += distance(said, ocr.spelt(reader.page(font.drawn(said))))
        chars += len(said)
    assert (got.errors, got.chars) == (errors, chars) and 0 < got.cer < 0.05


def test_files_and_codes(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.txt", bytearray(b"one")), ("b.txt", None)], "name string, content binary")
    files.save(rows, str(tmp_path), "name", "content")
    assert (tmp_path / "x" / "a.txt").read_bytes() == b"one" and (tmp_path / "b.txt").read_bytes() == b""
    assert not [p for p in tmp_path.rglob("*") if p.name.endswith(".part")]
    a = np.arange(35, dtype=np.uint8).reshape(5, 7)
    df = spark.createDataFrame([(1, 7, 5, bytearray(a.tobytes())), (2, 0, 5, None)], "image_id long, width int, height int, pixels binary")
    made = {r.image_id: r.content for r in images.with_file(df, "bmp").collect()}
    assert made[1][:2] == b"BM" and len(made[1]) == 54 + 5 * 24 and made[2] is None
    bad = images.from_pnm(spark.createDataFrame([(1, bytearray(b"P5\n2 1\n255\nab")), (2, bytearray(b"no")), (3, None)], "id long, c binary"), "id", "c")
    assert {r.image_id: (r.code, r.error) for r in bad.collect()} == {1: (registry.OK, None), 2: (registry.NOT_LOADED, "neither P5 nor P6"), 3: (registry.NOT_LOADED, "neither P5 nor P6")}
    assert {r.image_id: r.code for r in ocr.read_text(bad, [ocr.latin_pack()]).collect()}[2] == registry.NOT_LOADED


def test_names_never_clash(spark):
    df = spark.createDataFrame([("abc", "x", "y", "z", ["жж"])], "text string, profile string, lines_text string, own_languages string, lines array<string>")
    for out in (T.detect_languages(df), T.detect_lines(df, "lines"), T.result(df)):
        row = out.first()
        assert (row.profile, row.lines_text, row.own_languages) == ("x", "y", "z")


def test_full_circle(spark, tmp_path, capsys):
    (tmp_path / "en").mkdir()
    (tmp_path / "en" / "corpus.txt").write_text("\nHELLO\nABC\n")
    assert full_circle.main(["en", "ru", "hi", "--corpora", str(tmp_path), "--strict", "--json"]) == 0
    said = capsys.readouterr().out.strip().split("\n")
    rows = {r["lang"]: r for r in map(json.loads, said[:-1])}
    assert rows["en"]["ocr_text"] == "HELLO" and rows["en"]["ok"]
    if font.find_font():
        assert rows["ru"]["ok"] and rows["ru"]["name"] == "Russian" and rows["hi"]["detail"] == "not drawn"
