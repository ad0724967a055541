"""Languages and glyph packs of texts, from their code points.

``profile`` is one pass over the text: a Python function looks every code point up in tables built by rule from the Unicode
database and counts by row, a piece of one text at a time (``short``: over Arrow batches of words).  What follows (percentages, ranks, routing) are column expressions.  ``counts_by_patterns`` is
the same count by built-in functions alone, and ``counts_by_join`` by a broadcast range join; all three agree.

All work on batch and streaming DataFrames alike; only the range join shuffles.  A null text has no letters and is blank.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import registry
from scriptorium.functions.arrowtext import code_points, utf8
from scriptorium.functions.names import fresh

PROFILE = "struct<counts:array<int>,has_letter:boolean,ascii_ocr:boolean,native_ocr:boolean,pack_id:string>"
_LETTER, _SPACE, _NOT_ASCII, _FOREIGN = 1, 2, 4, 8
_OTHER = 255
#: Code points of a text that are looked up at once.
PIECE = 1 << 16


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """For every code point: its language (1 up, 0 none), its pack (1 up, 0 not a letter, 255 no pack) and flags."""
    n = sys.maxunicode + 1
    letter = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(n)), bool, n)
    language, pack, flags = np.zeros(n, np.uint8), np.where(letter, np.uint8(_OTHER), np.uint8(0)), letter.astype(np.uint8) * np.uint8(_LETTER | _FOREIGN)
    for lo, hi in registry.fallback():
        language[lo : hi + 1] = 1
    for k, (_, _, _, _, ranges, _, _) in enumerate(registry.LANGUAGES):
        for lo, hi in ranges:
            language[lo : hi + 1] = k + 1
            flags[lo : hi + 1] &= ~np.uint8(_FOREIGN)
    language[~letter] = 0
    packs = list(dict.fromkeys(p for p, _, _ in registry.pack_ranges()))
    for p, lo, hi in registry.pack_ranges():
        pack[lo : hi + 1] = np.where(letter[lo : hi + 1], packs.index(p) + 1, 0)
    space = np.zeros(n, bool)
    space[[i for i in range(0x3001) if chr(i).isspace()]] = True
    flags[space] |= _SPACE
    plain = np.zeros(n, bool)
    plain[32:127] = True
    flags[~space & ~plain] |= _NOT_ASCII
    return language, pack, flags, packs


def _profiles(texts: pa.Array) -> pa.Array:
    language, pack, flags, packs = tables()
    n_lang, n_pack = len(registry.LANGUAGES) + 1, len(packs) + 2
    counts, seen, vote = [np.zeros((0, n_lang), np.int64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int32)]
    for points, at in code_points(texts):
        n = len(at) - 1
        row = np.repeat(np.arange(n), np.diff(at))
        counts.append(np.bincount(row * n_lang + language[points], minlength=n * n_lang).reshape(n, n_lang))
        flag = flags[points]
        bits = np.zeros(n, np.uint8)
        for bit in (_LETTER, _NOT_ASCII, _FOREIGN):
            bits |= (np.bincount(row[(flag & bit) > 0], minlength=n) > 0).astype(np.uint8) * np.uint8(bit)
        filled = np.bincount(row[(flag & _SPACE) == 0], minlength=n) > 0
        bits |= (~filled).astype(np.uint8) * np.uint8(_SPACE)  # here: the text is blank
        seen.append(bits)
        votes = np.minimum(pack[points], n_pack - 1)
        each = np.bincount(row * n_pack + votes, minlength=n * n_pack).reshape(n, n_pack)
        best, most = each[:, 1:-1].argmax(axis=1), each[:, 1:-1].max(axis=1)
        for i in np.flatnonzero((most > 0) & ((each[:, 1:-1] == most[:, None]).sum(axis=1) > 1) & (each[:, -1] == 0)).tolist():
            tied = np.flatnonzero(each[i, 1:-1] == most[i]) + 1
            best[i] = next(x for x in votes[at[i] : at[i + 1]] if x in tied) - 1  # the first seen
        none = len(packs) + 1
        own = np.where((each[:, -1] > 0) | (most == 0), none, best)
        vote.append(np.where(~filled, none, np.where((bits & _NOT_ASCII) == 0, len(packs), own)).astype(np.int32))
    counts, seen, vote = np.concatenate(counts), np.concatenate(seen), np.concatenate(vote)
    n = len(counts)
    voted = pa.array([*packs, "latin", None], pa.string()).take(pa.array(vote))
    listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (n_lang - 1)), pa.array(counts[:, 1:].astype(np.int32).ravel()))
    filled, ascii_ = (seen & _SPACE) == 0, (seen & _NOT_ASCII) == 0
    native = filled & (ascii_ | ((seen & _FOREIGN) == 0))
    return pa.StructArray.from_arrays([listed, pa.array((seen & _LETTER) > 0), pa.array(filled & ascii_), pa.array(native), voted], ["counts", "has_letter", "ascii_ocr", "native_ocr", "pack_id"])


def _pieces(text: str) -> Iterator[np.ndarray]:
    for at in range(0, len(text), PIECE):
        yield np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)


def _profile(text: str | None) -> tuple[list[int], bool, bool, bool, str | None]:
    """What ``_profiles`` says of one text."""
    language, pack, flags, packs = tables()
    text = text or ""
    counts, votes = np.zeros(len(registry.LANGUAGES) + 1, np.int64), np.zeros(_OTHER + 1, np.int64)
    some, every = 0, _SPACE
    for points in _pieces(text):
        counts += np.bincount(language[points], minlength=len(counts))
        votes += np.bincount(pack[points], minlength=len(votes))
        flag = flags[points]
        some, every = some | int(np.bitwise_or.reduce(flag)), every & int(np.bitwise_and.reduce(flag))
    filled, ascii_ = not every & _SPACE, not some & _NOT_ASCII
    each = votes[1 : len(packs) + 1]
    voted = None
    if filled and ascii_:
        voted = "latin"
    elif filled and each.any() and not votes[_OTHER]:
        tied = np.flatnonzero(each == each.max()) + 1
        seen = (own[np.isin(own, tied)] for own in map(pack.__getitem__, _pieces(text))) if len(tied) > 1 else iter([tied])
        voted = packs[next(own for own in seen if len(own))[0] - 1]  # the first seen
    return counts[1:].tolist(), bool(some & _LETTER), filled and ascii_, filled and (ascii_ or not some & _FOREIGN), voted


def profile(text: Column | str, short: bool = False) -> Column:
    """Counts of letters by language (in registry order), whether there is a letter, whether the text is plain ASCII,
    whether glyph packs cover it, and the pack that its letters vote for.

    Texts go to Python as rows, 100 at once as Spark has it, so that a worker holds little more than those however large the
    tables are; an Arrow batch has 10,000 texts or 64 MB, and a worker may hold two.  Words and the like (``short``) go as
    Arrow batches, which have few bytes then, and are looked up many at a time."""

    def run(texts: pa.Array) -> pa.Array:
        return _profiles(texts)

    of = F.arrow_udf(run, PROFILE) if short else F.udf(_profile, PROFILE, useArrow=False)
    return of(F.col(text) if isinstance(text, str) else text)


def _array(values, kind: str = "string") -> Column:
    return F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>")


def ranked(counts: Column) -> Column:
    """array<struct<code, name, percent, reliable>> by percent, rounded half to even, downwards, then by name; empty if no
    letter counts.  The percentages need not add up to 100, and a language may have 0."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: acc + x)
    zipped = F.arrays_zip(_array(registry.CODES).alias("code"), _array(registry.NAMES).alias("name"), counts.alias("n"))
    found = F.transform(F.filter(zipped, lambda x: x["n"] > 0), lambda x: F.struct((-F.rint(x["n"] / total * 100)).cast("int").alias("order"), x["name"].alias("name"), x["code"].alias("code")))
    return F.transform(F.array_sort(found), lambda x: F.struct(x["code"].alias("code"), x["name"].alias("name"), (-x["order"]).alias("percent"), F.lit(True).alias("reliable")))


def detect_languages(df: DataFrame, text_col: str = "text", out: str = "languages") -> DataFrame:
    """Add the ranked languages of a text."""
    (p,) = fresh([*df.columns, out], "profile")
    return df.withColumn(p, profile(text_col)).withColumn(out, ranked(F.col(p)["counts"])).drop(p)


def detect_lines(df: DataFrame, lines_col: str, text_col: str = "text", out: str = "languages") -> DataFrame:
    """The same over an array of lines, which override the text unless there are none."""
    lines = F.filter(F.col(lines_col), lambda x: x.rlike(f"[^{registry.SPACES}]"))
    joined = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.when(F.size(F.coalesce(lines_col, F.array())) > 0, F.lit("")).otherwise(F.col(text_col)))
    (whole,) = fresh([*df.columns, out], "lines_text")
    return detect_languages(df.withColumn(whole, joined), whole, out).drop(whole)


def letter_counts(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, code, n for the languages that occur; equal keys are added up.

    ``posexplode`` alone would have Spark infer that there is something to explode, and profile each text once more to test that;
    outer, it doesn't."""
    rows = df.select(*keys, F.col("p.counts").alias("c")) if "p" in df.columns else df.select(*keys, profile(text_col).alias("p")).select(*keys, F.col("p.counts").alias("c"))
    long = rows.select(*keys, F.posexplode_outer("c").alias("k", "n")).where("n > 0").withColumn("code", F.element_at(_array(registry.CODES), F.col("k") + 1))
    return long.groupBy(*keys, "code").agg(F.sum("n").cast("long").alias("n"))


@lru_cache(32)
def letter_class(code: str) -> str:
    """A character class, without its brackets, of the letters that count for a language."""
    own = np.flatnonzero(tables()[0] == registry.CODES.index(code) + 1)
    cuts = np.flatnonzero(np.diff(own) > 1)
    return "".join(f"\\x{{{own[a]:X}}}-\\x{{{own[b]:X}}}" for a, b in zip(np.append(0, cuts + 1), np.append(cuts, len(own) - 1), strict=True))


@lru_cache(1)
def _signs() -> tuple[str, str]:
    """For ``translate``: every letter that counts becomes its language's sign, U+0001 on; other ASCII characters go."""
    own = tables()[0]
    points = np.flatnonzero(own)
    rest = [cp for cp in range(1, 128) if not own[cp]]
    return "".join(map(chr, points)) + "".join(map(chr, rest)), "".join(chr(own[cp]) for cp in points)


def counts_by_patterns(text: Column | str) -> Column:
    """The counts of ``profile`` with built-in functions only: each letter is replaced by its language's sign in one pass, then
    signs are counted by what is gone without them; those of English, the most frequent, go first."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    signs = F.translate(text, *_signs())
    without = lambda t, k: F.replace(t, F.lit(chr(k + 1)), F.lit(""))

    def count(pair: Column) -> Column:
        whole, rest = pair["whole"], pair["rest"]
        others = [F.when(rest != "", F.length(rest) - F.length(without(rest, k))).otherwise(0) for k in range(1, len(registry.CODES))]
        return F.array(F.length(whole) - F.length(rest), *others)

    bound = F.transform(F.array(signs), lambda t: F.struct(t.alias("whole"), without(t, 0).alias("rest")))
    return F.element_at(F.transform(bound, count), 1)


def counts_by_join(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, code, n by a broadcast range join of the distinct letters of each row with the ranges (a fixed 33 and the
    fallback's).  A letter is counted within its row, by what is gone without it, so a row is sent on once for each distinct
    letter; counts are added up after the join, map side first."""
    spark = df.sparkSession
    letters = "".join(letter_class(c) for c in registry.CODES)
    text = F.coalesce(text_col, F.lit(""))
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c.rlike(f"^[{letters}]"))
    counted = F.transform(chars, lambda c: F.struct(F.ascii(c).alias("cp"), (F.length(text) - F.length(F.replace(text, c, F.lit("")))).alias("m")))
    points = df.select(*keys, F.inline(counted))
    extra = spark.createDataFrame([("en", lo, hi) for lo, hi in registry.fallback()], "code string, start int, end int")
    dim = registry.ranges(spark).select("code", "start", "end").union(extra)
    hit = points.join(F.broadcast(dim), (F.col("cp") >= F.col("start")) & (F.col("cp") <= F.col("end")))
    return hit.groupBy(*keys, "code").agg(F.sum("m").cast("long").alias("n"))


def stripped(text: Column | str) -> Column:
    """Without white space at the ends, white space as str.strip() has it."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(text, f"^[{registry.SPACES}]+|[{registry.SPACES}]+$", "")


def normal_quotes(text: Column | str) -> Column:
    """Stripped, with typographic quotes made plain."""
    return F.translate(stripped(text), *registry.QUOTES)


def is_blank(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return ~F.coalesce(text.rlike(f"[^{registry.SPACES}]"), F.lit(False))


def lines_of(text: Column | str) -> Column:
    """The lines that are not blank, ends as str.splitlines() has them."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(text, "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"), lambda x: x.rlike(f"[^{registry.SPACES}]"))


def folded(text: Column | str) -> Column:
    """For comparing recognised text: NFC, without white space, case folded."""

    def run(texts: pa.Array) -> pa.Array:
        raw, at = utf8(texts)
        wide = np.diff(np.concatenate([[0], np.cumsum(raw[at[0] : at[-1]] >= 128)])[at - at[0]]) > 0
        plain = pc.ascii_lower(pc.replace_substring_regex(texts, "[\\t-\\r\\x1c- ]+", ""))
        if not wide.any():
            return plain
        found = [None if t is None else "".join(unicodedata.normalize("NFC", t).split()).casefold() for t in texts.filter(pa.array(wide)).to_pylist()]
        return pc.replace_with_mask(plain, pa.array(wide), pa.array(found, plain.type))

    return F.arrow_udf(run, "string")(F.col(text) if isinstance(text, str) else text)


def character(cp: Column | str) -> Column:
    """The character of a code point; none for 0."""
    cp = F.col(cp) if isinstance(cp, str) else cp
    return F.when(cp > 0, F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")).otherwise("")


def u_plus(cp: Column | str) -> Column:
    """U+ and at least four hexadecimal digits."""
    digits = F.hex(F.col(cp) if isinstance(cp, str) else cp)
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def language_of_point(cp: Column | str) -> Column:
    """The code of the language whose range holds a code point, letter or not; else null."""
    cp = F.col(cp) if isinstance(cp, str) else cp
    out = None
    for code, _, _, _, ranges, _, _ in registry.LANGUAGES:
        test = F.lit(False)
        for lo, hi in ranges:
            test = test | cp.between(lo, hi)
        out = F.when(test, code) if out is None else out.when(test, code)
    return out


def renderer(profile_col: Column) -> Column:
    """How a text would be drawn: in the terminal font, in a pack's font, or in any Unicode font."""
    return F.when(profile_col["ascii_ocr"], "terminal_ppm").when(profile_col["pack_id"].isNotNull() & (profile_col["pack_id"] != "latin"), "ocr_png").otherwise("unicode_png")


def identification(ocr_text: Column, hint: Column, hint_profile: Column) -> Column:
    """Where a result comes from: no usable hint or recognised text alone is ocr, both are hybrid, the hint alone unicode."""
    usable = hint.isNotNull() & F.coalesce(hint_profile["has_letter"], F.lit(False))
    return F.when(~usable, "ocr").when(~is_blank(ocr_text), "hybrid").otherwise("unicode")


def result(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add a ``result`` struct as text detection gives it: text, languages, mean_confidence, glyph_count, ocr_text, source."""
    (own,) = fresh([*df.columns, "result"], "own_languages")
    found = detect_languages(df, text_col, own)
    whole = F.struct(F.col(text_col).alias("text"), F.col(own).alias("languages"), F.lit(0.0).alias("mean_confidence"), F.lit(0).alias("glyph_count"), F.lit("").alias("ocr_text"), F.lit("unicode").alias("identification_source"))
    return found.withColumn("result", whole).drop(own)


def error_rate(df: DataFrame, groups: list[str], expected: str, got: str) -> DataFrame:
    """Edit distance over characters, summed over each group, over the expected characters (1 at least)."""
    per = df.select(*groups, F.levenshtein(F.coalesce(expected, F.lit("")), F.coalesce(got, F.lit(""))).alias("d"), F.length(F.coalesce(expected, F.lit(""))).alias("n"), (~F.col(expected).eqNullSafe(F.col(got))).cast("int").alias("f"))
    out = per.groupBy(*groups).agg(F.count("*").alias("strings"), F.sum("f").cast("long").alias("failures"), F.sum("d").cast("long").alias("errors"), F.sum("n").cast("long").alias("chars"))
    return out.withColumn("cer", F.col("errors") / F.greatest("chars", F.lit(1)))
