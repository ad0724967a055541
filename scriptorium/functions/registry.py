"""The 21 languages, their Unicode ranges and glyph packs, and small tables derived from them by rule."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# Code, name, script, regions, inclusive ranges, sample letter, glyph pack.
LANGUAGES = (
    ("en", "English", "Latin alphabet", ("Global", "United States", "United Kingdom", "Australia"), ((0x0041, 0x007A), (0x00C0, 0x00FF), (0x0100, 0x024F)), "A", "latin"),
    ("ru", "Russian", "Cyrillic alphabet", ("Russia", "Eastern Europe", "Central Asia"), ((0x0400, 0x04FF), (0x0500, 0x052F)), "а", "cyrillic"),
    ("ar", "Arabic", "Arabic alphabet", ("Middle East", "North Africa"), ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)), "ا", "arabic"),
    ("he", "Hebrew", "Hebrew alphabet", ("Israel",), ((0x0590, 0x05FF),), "א", "hebrew"),
    ("el", "Greek", "Greek alphabet", ("Greece", "Cyprus"), ((0x0370, 0x03FF), (0x1F00, 0x1FFF)), "α", "greek"),
    ("hy", "Armenian", "Armenian alphabet", ("Armenia",), ((0x0530, 0x058F),), "ա", "armenian"),
    ("ka", "Georgian", "Georgian script (Mkhedruli)", ("Georgia",), ((0x10A0, 0x10FF), (0x2D00, 0x2D2F)), "ა", "georgian"),
    ("hi", "Hindi", "Devanagari", ("India",), ((0x0900, 0x097F),), "ह", "devanagari"),
    ("bn", "Bengali", "Bengali–Assamese script", ("Bangladesh", "India (West Bengal)"), ((0x0980, 0x09FF),), "ব", "bengali"),
    ("pa", "Punjabi", "Gurmukhi script", ("India (Punjab)",), ((0x0A00, 0x0A7F),), "ਪ", "gurmukhi"),
    ("gu", "Gujarati", "Gujarati script", ("India (Gujarat)",), ((0x0A80, 0x0AFF),), "ગ", "gujarati"),
    ("or", "Odia", "Odia script", ("India (Odisha)",), ((0x0B00, 0x0B7F),), "ଓ", "odia"),
    ("ta", "Tamil", "Tamil script", ("India (Tamil Nadu)", "Sri Lanka", "Singapore"), ((0x0B80, 0x0BFF),), "த", "tamil"),
    ("te", "Telugu", "Telugu script", ("India (Andhra Pradesh)", "India (Telangana)"), ((0x0C00, 0x0C7F),), "త", "telugu"),
    ("kn", "Kannada", "Kannada script", ("India (Karnataka)",), ((0x0C80, 0x0CFF),), "ಕ", "kannada"),
    ("ml", "Malayalam", "Malayalam script", ("India (Kerala)",), ((0x0D00, 0x0D7F),), "മ", "malayalam"),
    ("si", "Sinhala", "Sinhala script", ("Sri Lanka",), ((0x0D80, 0x0DFF),), "ස", "sinhala"),
    ("th", "Thai", "Thai script", ("Thailand",), ((0x0E00, 0x0E7F),), "ท", "thai"),
    ("lo", "Lao", "Lao script", ("Laos",), ((0x0E80, 0x0EFF),), "ລ", "lao"),
    ("my", "Burmese", "Myanmar script", ("Myanmar",), ((0x1000, 0x109F), (0xAA60, 0xAA7F)), "မ", "myanmar"),
    ("am", "Amharic", "Ge'ez (Ethiopic) script", ("Ethiopia",), ((0x1200, 0x137F), (0x1380, 0x139F), (0x2D80, 0x2DDF)), "አ", "ethiopic"),
)

# Pack, grid width and height, threshold, weights of overlap, structure and aspect, calibration a and b, right to left.
PACKS = (
    ("latin", 20, 28, 0.30, 0.55, 0.25, 0.20, 1.05, -0.02, False),
    ("cyrillic", 28, 40, 0.15, 0.85, 0.05, 0.10, 1.08, -0.04, False),
    ("greek", 28, 40, 0.15, 0.85, 0.05, 0.10, 1.06, -0.03, False),
    ("armenian", 28, 40, 0.15, 0.85, 0.05, 0.10, 1.06, -0.03, False),
    ("georgian", 28, 40, 0.15, 0.85, 0.05, 0.10, 1.06, -0.03, False),
    ("hebrew", 28, 40, 0.15, 0.85, 0.05, 0.10, 1.04, -0.02, True),
    ("thai", 28, 40, 0.15, 0.82, 0.08, 0.10, 1.05, -0.03, False),
    ("lao", 28, 40, 0.15, 0.82, 0.08, 0.10, 1.05, -0.03, False),
    ("myanmar", 28, 40, 0.14, 0.55, 0.35, 0.10, 1.10, -0.05, False),
    ("ethiopic", 40, 56, 0.14, 0.80, 0.10, 0.10, 1.04, -0.02, False),
    ("devanagari", 32, 48, 0.14, 0.75, 0.15, 0.10, 1.08, -0.04, False),
    ("bengali", 32, 48, 0.14, 0.75, 0.15, 0.10, 1.08, -0.04, False),
    ("gurmukhi", 32, 48, 0.14, 0.75, 0.15, 0.10, 1.08, -0.04, False),
    ("gujarati", 32, 48, 0.14, 0.75, 0.15, 0.10, 1.08, -0.04, False),
    ("odia", 32, 48, 0.14, 0.75, 0.15, 0.10, 1.08, -0.04, False),
    ("tamil", 32, 48, 0.14, 0.75, 0.15, 0.10, 1.08, -0.04, False),
    ("telugu", 32, 48, 0.14, 0.75, 0.15, 0.10, 1.08, -0.04, False),
    ("kannada", 32, 48, 0.14, 0.75, 0.15, 0.10, 1.08, -0.04, False),
    ("malayalam", 32, 48, 0.14, 0.75, 0.15, 0.10, 1.08, -0.04, False),
    ("sinhala", 32, 48, 0.14, 0.75, 0.15, 0.10, 1.08, -0.04, False),
    ("arabic", 32, 48, 0.13, 0.72, 0.18, 0.10, 1.07, -0.04, True),
)
INDIC_PACKS = ("devanagari", "bengali", "gurmukhi", "gujarati", "odia", "tamil", "telugu", "kannada", "malayalam", "sinhala")

# Pairs of Arabic letters and the ligature that replaces them.
LIGATURES = ((0x0644, 0x0627, 0xFEFB), (0x0644, 0x0622, 0xFEF5), (0x0644, 0x0623, 0xFEF7), (0x0644, 0x0625, 0xFEF9), (0x0644, 0x0644, 0xFDF2), (0x0627, 0x0644, 0xFDF2), (0x0644, 0x0645, 0xFEDF), (0x0644, 0x0647, 0xFEE0), (0x0641, 0x064A, 0xFEF0), (0x0628, 0x064A, 0xFE91))

# Quotes, and the largest character error rate that a language may have.
QUOTES = ("“”«»‘’", "\"\"\"\"''")
ERROR_BUDGET = {"en": 0.05, "ru": 0.05, "el": 0.05, "hy": 0.05, "ka": 0.05, "he": 0.05, "th": 0.05, "lo": 0.05, "my": 0.05, "am": 0.05, "hi": 0.08, "bn": 0.08, "pa": 0.08, "gu": 0.08, "or": 0.08, "ta": 0.08, "te": 0.08, "kn": 0.08, "ml": 0.08, "si": 0.08, "ar": 0.10}

# White space as str.strip() and str.isspace() have it, for a class in a regular expression.
SPACES = "\t-\r\x1c- \x85\xa0  -     　"

# Result codes; all is well, a file can't be loaded, a page can't be processed, no memory, nothing to read.
OK, NOT_LOADED, NOT_PROCESSED, NO_MEMORY, NOTHING = 0, -1, -2, -3, -4

CODES = tuple(x[0] for x in LANGUAGES)
NAMES = tuple(x[1] for x in LANGUAGES)
PACK_OF = {x[0]: x[6] for x in LANGUAGES}
LANGUAGE_OF_PACK = {x[6]: x[0] for x in LANGUAGES}


def pack_ranges() -> list[tuple[str, int, int]]:
    """Ranges in which letters vote for a pack.  They are narrower than the languages': no Latin, no Cyrillic supplement and
    no Arabic presentation forms."""
    out = []
    for code, _, _, _, ranges, _, pack in LANGUAGES:
        if code != "en":
            out += [(pack, lo, hi) for lo, hi in ranges if (code, lo) not in {("ru", 0x0500), ("ar", 0xFB50), ("ar", 0xFE70)}]
    return out


@lru_cache(1)
def fallback() -> tuple[tuple[int, int], ...]:
    """Ranges of letters outside all languages' ranges whose Unicode name has LATIN in it: they count as English."""
    taken = np.zeros(sys.maxunicode + 1, bool)
    for x in LANGUAGES:
        for lo, hi in x[4]:
            taken[lo : hi + 1] = True
    points = [cp for cp in range(sys.maxunicode + 1) if not taken[cp] and not 0x3000 <= cp <= 0xA4FF and not 0xAC00 <= cp <= 0xF8FF and not 0x1F000 <= cp and unicodedata.category(chr(cp))[0] == "L" and "LATIN" in unicodedata.name(chr(cp), "")]
    out: list[list[int]] = []
    for cp in points:
        if out and out[-1][1] == cp - 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return tuple((a, b) for a, b in out)


def letters_of(code: str, n: int = 26) -> str:
    """The first n small or caseless letters of a language's ranges."""
    ranges = next(x[4] for x in LANGUAGES if x[0] == code)
    found = (chr(cp) for lo, hi in ranges for cp in range(lo, hi + 1) if unicodedata.category(chr(cp)) in ("Ll", "Lo"))
    return "".join(c for c, _ in zip(found, range(n), strict=False))


def languages(spark: SparkSession) -> DataFrame:
    rows = [(i, c, n, s, list(r), [{"start": a, "end": b} for a, b in u], m, True) for i, (c, n, s, r, u, m, _) in enumerate(LANGUAGES)]
    return spark.createDataFrame(rows, "seq int, code string, name string, script string, regions array<string>, unicode_ranges array<struct<start:int,end:int>>, sample_char string, ocr_native boolean").coalesce(1)


def ranges(spark: SparkSession) -> DataFrame:
    """code, name, start, end: the languages' ranges, flattened."""
    return languages(spark).selectExpr("code", "name", "inline(unicode_ranges)")


def packs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PACKS)], "seq int, pack_id string, grid_w int, grid_h int, threshold double, w_ncc double, w_struct double, w_aspect double, cal_a double, cal_b double, rtl boolean").coalesce(1)


def budgets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ERROR_BUDGET.items()), "code string, max_cer double").coalesce(1)
